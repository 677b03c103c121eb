import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelkit.operators import titles as TT

D = dt.date(2023, 8, 1)


def _cand(spark, rows):
    return spark.createDataFrame(rows, "date date, ord long, title string, keywords_count int")


def test_titles_nonzero_drops_zero_counts_and_null_titles(spark):
    c = _cand(spark, [(D, 1, "a", 0), (D, 2, "b", 3), (D, 3, None, 2)])
    assert [r.title for r in TT.titles_nonzero(c).collect()] == ["b"]


def test_top_titles_eval_order(spark):
    rows = [(D, 1, "x", 1), (D, 2, "b", 5), (D, 3, "a", 5), (D, 4, "c", 2),
            (D + dt.timedelta(1), 5, "z", 1), (D + dt.timedelta(1), 6, "y", 9)]
    out = {r.date: r.titles for r in TT.top_titles_per_day(_cand(spark, rows), 2).collect()}
    assert out[D] == ["b", "a"]                    # count desc, then title desc
    assert out[D + dt.timedelta(1)] == ["z", "y"]  # k or fewer: original order


def _pairs(spark, n_windows, weights, k=2, seed=0, parts=4):
    wd = spark.range(n_windows).select(F.lit("train").alias("split"), F.lit(D).alias("date"),
                                      F.lit("T").alias("ticker"), F.col("id").alias("sample_id"),
                                      F.lit(0).alias("replica"), F.lit(0).alias("day_idx")).repartition(parts)
    cand = spark.createDataFrame([("train", D, i, f"t{i}", w) for i, w in enumerate(weights)],
                                 "split string, date date, ord long, title string, keywords_count int")
    return TT.sample_titles(wd, cand, k, seed, ["split", "ticker", "sample_id", "replica", "day_idx"])


@pytest.mark.parametrize("k", [2, 9, 100])
def test_every_window_day_gets_its_titles(spark, k):
    # one candidate has nearly all the weight, so most draws repeat it
    weights = [10 ** 9] + [1] * 120
    rows = _pairs(spark, 20, weights, k=k).collect()
    per = Counter(r.sample_id for r in rows)
    assert len(per) == 20 and set(per.values()) == {k}
    assert all(sorted(r._rank for r in rows if r.sample_id == s) == list(range(1, k + 1)) for s in per)
    assert len({(r.sample_id, r.ord) for r in rows}) == len(rows)
    few = _pairs(spark, 5, [3, 1, 2], k=k).collect()
    assert set(Counter(r.sample_id for r in few).values()) == {min(k, 3)}


def test_sampling_size_no_repeats_and_repeatable(spark):
    weights = [1, 2, 3, 5, 8, 13]
    a = _pairs(spark, 200, weights).collect()
    per = Counter(r.sample_id for r in a)
    assert set(per.values()) == {2}                                   # exactly k per window
    assert all(len({r.ord for r in a if r.sample_id == s}) == 2 for s in per)   # no repeats
    b = _pairs(spark, 200, weights, parts=7).collect()                # other partitioning
    assert sorted((r.sample_id, r.ord, r._rank) for r in a) == sorted((r.sample_id, r.ord, r._rank) for r in b)
    c = _pairs(spark, 200, weights, seed=1).collect()
    assert sorted((r.sample_id, r.ord) for r in a) != sorted((r.sample_id, r.ord) for r in c)


def test_sampling_frequency_rises_with_weight(spark):
    weights = [1, 1, 4, 20, 60]
    rows = _pairs(spark, 4000, weights, k=1).collect()
    freq = Counter(r.ord for r in rows)
    p = [__import__("math").log1p(w) for w in weights]
    tot = sum(p)
    for i, w in enumerate(p):
        assert abs(freq[i] / 4000 - w / tot) < 0.03
    assert freq[4] > freq[3] > freq[2] > max(freq[0], freq[1])


def test_replicate_and_filters(spark):
    df = spark.createDataFrame([(1, [["a"], [], ["b", "c"]]), (2, [["a"], ["b"], []])],
                               "id int, title array<array<string>>")
    assert TT.replicate_samples(df, 3).count() == 6
    assert TT.replicate_samples(df, 1).count() == 2
    assert [r.id for r in TT.min_titles_filter(df, 3).collect()] == [1]
    assert [r.id for r in TT.last_day_titles_filter(df).collect()] == [1]


@pytest.mark.parametrize("k,is_train", [(2, False), (1, True), (100, False)])
def test_cut_titles_lists(spark, k, is_train):
    df = spark.createDataFrame(
        [("A", 1, [["a", "b", "c"], None, ["d", "e"]], [[1, 0, 3], None, [2, 2]])],
        "ticker string, sample_id int, title array<array<string>>, keywords_count array<array<int>>")
    out = TT.cut_titles_lists(df, k, is_train).collect()[0].title
    assert out[1] == []                                   # NULL day -> []
    assert "b" not in out[0]                              # zero count dropped
    if k == 2 and not is_train:
        assert out == [["a", "c"], [], ["d", "e"]]        # <= k keeps order
    if is_train:
        assert all(len(d) <= 1 for d in out)
    if k == 100:
        assert out == [["a", "c"], [], ["d", "e"]]


def test_rank_within_matches_window_rank(spark):
    from pyspark.sql import Window
    from panelkit.operators.news import rank_within
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 100003).alias("o"))
    got = rank_within(df, ["g"], "o", bucket=997).select("g", "o", "pos")
    exp = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("o")) - 1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))



def test_draws_exactly_k_distinct_and_repeatable(spark):
    weights = [1, 2, 3, 5, 8, 13, 1, 1]
    a = _pairs(spark, 300, weights, k=3).collect()
    per = Counter(r.sample_id for r in a)
    assert len(per) == 300 and set(per.values()) == {3}
    assert all(len({r.ord for r in a if r.sample_id == s}) == 3 for s in per)
    b = _pairs(spark, 300, weights, k=3, parts=9).collect()
    assert sorted((r.sample_id, r.ord, r._rank) for r in a) == sorted((r.sample_id, r.ord, r._rank) for r in b)


def test_draws_follow_successive_sampling(spark):
    import math
    weights = [1, 1, 4, 20, 60]
    w = [math.log1p(x) for x in weights]
    n = 6000
    rows = _pairs(spark, n, weights, k=2).collect()
    first = Counter(r.ord for r in rows if r._rank == 1)
    for i, wi in enumerate(w):
        assert abs(first[i] / n - wi / sum(w)) < 0.025
    # inclusion probability of a 2-draw without replacement
    incl = Counter(r.ord for r in rows)
    for i, wi in enumerate(w):
        p = wi / sum(w) + sum(wj / sum(w) * wi / (sum(w) - wj) for j, wj in enumerate(w) if j != i)
        assert abs(incl[i] / n - p) < 0.03
