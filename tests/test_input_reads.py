"""Inputs of the dataset build are read once, and keywords counted without regexes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelkit.operators import news as N
from panelkit.operators import titles as TT
from panelkit.params import Params, frames
from panelkit.plans.pipeline import samples

D = dt.date(2024, 1, 1)


def _counted(df, acc):
    """`df` whose rows are counted whenever they are read."""
    def run(batches):
        for b in batches:
            acc.add(b.num_rows)
            yield b
    return df.mapInArrow(run, df.schema)


def test_bars_and_news_are_read_once(spark):
    days = [D + dt.timedelta(k) for k in range(14)]
    bars = spark.createDataFrame(
        [(d, t, 1.0 + i, 2.0, 0.5, 1.5, 1.5, 10.0) for t in ("A", "B") for i, d in enumerate(days)],
        "date date, ticker string, open double, high double, low double, close double, adj_close double, volume double")
    news = spark.createDataFrame(
        [(d, f"u{i}.{j}", "s", f"t{i}.{j}", "key and key", 10 * i + j) for i, d in enumerate(days) for j in range(4)],
        "date date, url string, source string, title string, article string, ord long")
    p = Params(frames=frames(*[(s, days[0], days[-1]) for s in ("train", "val", "test")]), keywords=("key",))
    n_bars, n_news = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    out = samples(spark, _counted(bars, n_bars), _counted(news, n_news), p)
    assert out.groupBy("split").count().collect() and out.filter("split = 'val'").count() == 2 * (14 - 6 + 1)
    assert (n_bars.value, n_news.value) == (28, 56)


def test_draws_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)
    group = ["split", "ticker", "sample_id", "replica", "day_idx"]
    wd = spark.range(40).select(F.lit("train").alias("split"), F.lit(D).alias("date"), F.lit("T").alias("ticker"),
                                F.col("id").alias("sample_id"), F.lit(0).alias("replica"), F.lit(0).alias("day_idx"))
    cand = spark.createDataFrame([("train", D, i, f"t{i}", 1 + i) for i in range(9)],
                                 "split string, date date, ord long, title string, keywords_count int")
    got = TT.sample_titles(_counted(wd, seen), cand, 2, 3, group)
    assert got.count() == 80
    assert seen.value <= 80                  # for the draws, and to see which fell short
    lazy = TT.sample_titles(wd, cand, 2, 3, group, materialize=False)
    assert sorted(got.collect()) == sorted(lazy.collect())


TEXTS = ["", None, "aaaa", "aXaaXa", "the tion theque", "tthhee", "été aüa été", "\U0001f600a\U0001f600", "a.b a+b a\\b", "TIONtion\ntion"]


@pytest.mark.parametrize("words", [("a",), ("aa",), ("tion", "the", "que"), ("é", "a"), ("a.b",), ("a+",), ("",), ("\\",), ("a b", "X")])
@pytest.mark.parametrize("literal", [False, True])
def test_keyword_counts_equal_regex_matches(spark, words, literal):
    import re
    if not literal and words == ("\\",):
        return
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, article string")
    want = [sum(len(re.findall(re.escape(w) if literal else w, t or "")) for w in words) for t in TEXTS]
    got = N.keyword_count(df, words, literal)
    assert got.columns == ["k", "article", "keywords_count"] and dict(got.dtypes)["keywords_count"] == "int"
    if words != ("",):                       # an empty pattern matches between UTF-16 units in Java
        assert [r.keywords_count for r in got.orderBy("k").collect()] == want


def test_plain_keywords_are_searched_once_and_without_regexes(spark):
    df = spark.createDataFrame([("the end", "t")], "article string, title string")
    plan = TT.titles_nonzero(N.keyword_count(df, ["the", "end"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and plan.count("the, )") == 1, plan
