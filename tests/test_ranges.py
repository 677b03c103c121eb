"""Ranges cut by splitters, exact quantiles of many groups, daily lists and the
blocked nearest-vector search, against plain Python."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import news as N
from panelkit.operators import profiling as PR
from panelkit.operators import targets as TG
from panelkit.operators.ranges import grouped_quantiles, order_ranges


def test_sparse_order_values_make_even_ranges(spark):
    # one day holds a third of all rows; its order values are far apart and uneven
    rows = [(1, float(k) ** 3 * 1e6) for k in range(4000)] + [(2 + k % 40, float(k)) for k in range(8000)] + [(None, 5.0), (1, None)]
    df = spark.createDataFrame(rows, "day int, o double").repartition(5)
    sizes = {}
    for r in order_ranges(df, ["day"], "o", 500).groupBy("day", "_range").count().collect():
        sizes.setdefault(r["day"], []).append(r["count"])
    assert len(sizes[1]) > 100 and max(sizes[1]) < 200
    assert all(len(v) == 1 for d, v in sizes.items() if d != 1)


def test_positions_and_lists_of_a_large_day(spark):
    day, other = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    news = [(day, k * 10_000_019, f"t{k}" if k % 7 else None, k) for k in range(900)] + [(other, 5, "x", 1), (None, 1, "y", 2)]
    df = spark.createDataFrame(news, "date date, ord long, title string, keywords_count long").repartition(4)
    pos = {(r.date, r.pos): r.title for r in N.rank_within(df, ["date"], "ord", bucket=50).collect()}
    assert [pos[day, k] for k in range(900)] == [t for _, _, t, _ in news[:900]] and pos[other, 0] == "x" and pos[None, 0] == "y"
    lists = N.daily_news_lists(df, most=100).orderBy("date", "part").collect()
    assert [(r.date, r.part, len(r.title)) for r in lists] == [(None, 0, 1), *[(day, k, 100) for k in range(9)], (other, 0, 1)]
    assert sum((r.keywords_count for r in lists if r.date == day), []) == list(range(900))
    whole = {r.date: r.title for r in N.daily_news_lists(df).collect()}
    assert whole[day] == [t for _, _, t, _ in news[:900]]
    assert N.daily_news_lists(df.limit(0)).collect() == []
    totals = {r.date: (r.n_titles, r.kw) for r in N.daily_news_totals(df).collect()}
    assert totals[day] == (900, sum(range(900))) and totals[other] == (1, 1)


@pytest.mark.parametrize("buckets", [4, 128])
def test_grouped_quantiles_equal_numpy(spark, buckets):
    rng = np.random.default_rng(6)
    held = {"a": rng.normal(size=3000), "b": np.repeat(rng.integers(0, 5, 40), 30).astype(float), "c": np.array([7.0]),
            "d": np.zeros(500), None: rng.exponential(size=77), "e": np.array([1.0, 2.0])}
    rows = [(g, float(x)) for g, xs in held.items() for x in xs] + [("a", None), ("a", float("nan")), ("z", None), ("z", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    got = {r.g: r.q for r in grouped_quantiles(df, probs, ["g"], "x", buckets=buckets).collect()}
    assert set(got) == set(held)
    for g, xs in held.items():
        np.testing.assert_allclose(got[g], np.quantile(xs, probs), rtol=1e-12, atol=1e-12)


def test_box_stats_and_edges_hold_no_group_buffer(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 1.5).alias("x"))
    got = {r.g: (r.min, r.q1, r.median, r.q3, r.max) for r in PR.box_stats(df, "x", ["g"]).collect()}
    for g in range(3):
        xs = [1.5 * k for k in range(1000) if k % 3 == g]
        np.testing.assert_allclose(got[g], np.quantile(xs, [0, 0.25, 0.5, 0.75, 1]))
    edges = {r.g: r.edges for r in TG.grouped_equal_frequency_edges(df.union(df.limit(0)), 3, ["g"], "x").collect()}
    np.testing.assert_allclose(edges[0], np.quantile([1.5 * k for k in range(0, 1000, 3)], [0, 1 / 3, 2 / 3, 1]))
    assert PR.box_stats(df.limit(0), "x", ["g"]).collect() == []


def plain_nearest(queries, vectors, k):
    out = {}
    for q, v in queries:
        a = np.array(v, dtype=float)
        found = []
        for i, w in vectors:
            b = np.array(w, dtype=float)
            if i != q and len(a) == len(b):
                found.append((-round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 12), i))
        out[q] = [i for _, i in sorted(set(found))[:k]]
    return {q: m for q, m in out.items() if m}


@pytest.mark.parametrize("block,ask", [(32 << 20, 8 << 20), (2000, 900)])
def test_nearest_vectors_of_many_queries(spark, monkeypatch, block, ask):
    monkeypatch.setattr(PR, "BLOCK_BYTES", block)
    monkeypatch.setattr(PR, "QUERY_BYTES", ask)
    rng = np.random.default_rng(9)
    sound = [(k, rng.integers(-3, 4, 6).astype(float).tolist()) for k in range(300)]
    sound = [(k, v) for k, v in sound if any(v)]
    sound += [(1000 + k, sound[k][1]) for k in range(50)] + [(2000 + k, [1.0, float(k)]) for k in range(5)] + [(3000, [1.0] * 9)]
    odd = [(4000, None), (4001, [0.0] * 6), (4002, [float("nan")] * 6), (4003, [None] * 6), (4004, []), (None, sound[0][1]),
           (4005, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame(sound + odd + sound[:3], "vec_id long, embedding array<double>").withColumn("sim", F.lit(1))
    queries = [(i, v) for i, v in sound if i % 5 == 0]
    got = {}
    for r in PR.nearest_vectors(df.filter("vec_id % 5 = 0"), df, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.match_id)
    assert got == plain_nearest(queries, sound, 4)
    assert PR.nearest_vectors(df.limit(0), df).collect() == [] and PR.nearest_vectors(df, df.limit(0)).collect() == []
