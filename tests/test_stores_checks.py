import datetime as dt

import pytest
from pyspark.sql.functions import lit as F_lit

from panelkit.operators import bars as B
from panelkit.operators import news as N
from panelkit.operators import quality as Q


def _bars(spark):
    d0 = dt.date(2023, 8, 1)
    return spark.createDataFrame([(d0 + dt.timedelta(i), t, 1.0, 1.0) for i in range(10) for t in ("AAPL", "GOOGL")],
                                 "date date, ticker string, open double, close double")


def test_price_scan_checks(spark):
    b = _bars(spark)
    assert B.price_scan(b, ["AAPL"], "2023-08-02", "2023-08-03").count() == 2
    with pytest.raises(Exception, match="unknown ticker or range"):
        B.price_scan(b, ["MSFT"], "2023-08-02", "2023-08-03").collect()
    with pytest.raises(Exception, match="unknown ticker or range"):
        B.price_scan(b, ["AAPL"], "2023-07-01", "2023-08-03").collect()


def test_driver_side_request_checks():
    known = ["AAPL", "GOOGL"]
    B.check_price_request("2023-08-01", "2023-08-01", "AAPL", "2023-08-01", "2023-08-10", known)   # end == start ok
    with pytest.raises(ValueError):
        B.check_price_request("2023-08-05", "2023-08-01", "AAPL", "2023-08-01", "2023-08-10", known)
    with pytest.raises(ValueError):
        B.check_price_request("2024-01-01", "2024-01-05", "AAPL", "2023-08-01", "2023-08-10", known)
    with pytest.raises(ValueError):
        B.check_price_request("2023-08-01", "2023-08-02", ["TSLA"], "2023-08-01", "2023-08-10", known)
    with pytest.raises(ValueError):
        B.check_price_request("2023-08-01", "2023-08-02", [], "2023-08-01", "2023-08-10", known)
    with pytest.raises(ValueError):
        N.check_news_range("2023-08-01", "2023-08-01")      # news needs end > start


def test_unknown_tickers_and_checks_table(spark):
    asked = spark.createDataFrame([("AAPL",), ("TSLA",)], "ticker string")
    assert [r.ticker for r in Q.unknown_tickers(asked, _bars(spark)).collect()] == ["TSLA"]
    rows = {r.ticker: r.is_known for r in Q.ticker_checks(asked, _bars(spark)).collect()}
    assert rows == {"AAPL": True, "TSLA": False}


def test_news_scan_missing_store_is_empty(spark, tmp_path):
    df = N.news_scan(spark, str(tmp_path / "nothing_here"), fmt="parquet")
    assert df.count() == 0 and df.columns == ["date", "url", "source", "title", "article"]


def test_missing_dates_newest_first_and_resume(spark):
    news = spark.createDataFrame([(dt.date(2023, 1, 2), "u1"), (dt.date(2023, 1, 4), "u2")], "date date, url string")
    miss = [r.date.day for r in N.missing_dates(news, "2023-01-01", "2023-01-05").collect()]
    assert miss == [5, 3, 1]
    assert N.resume_point(news, "2022-12-01").collect()[0].resume_date == dt.date(2023, 1, 5)
    empty = news.filter("false")
    assert N.resume_point(empty, "2022-12-01").collect()[0].resume_date == dt.date(2022, 12, 1)


def test_date_parse_check(spark):
    df = spark.createDataFrame([("2023-09-09",), ("01-01-2000",), ("2021-99-99",)], "s string")
    got = {r.s: (r.format_ok, r.parsed) for r in Q.date_parse_check(df, "s").collect()}
    assert got["2023-09-09"] == (True, dt.date(2023, 9, 9))
    assert got["01-01-2000"] == (False, None)
    assert got["2021-99-99"] == (True, None)            # format-only check passes, parse fails


def test_keyword_count_regex_semantics(spark):
    df = spark.createDataFrame([("Apple TVV and Apple TV+ and Ringing",), (None,)], "article string")
    got = [r.keywords_count for r in N.keyword_count(df, ["Apple TV+", "Ring"]).collect()]
    assert got == [3, 0]                                 # regex '+' repeats 'V'; substrings count; NULL -> 0
    lit = [r.keywords_count for r in N.keyword_count(df, ["Apple TV+"], literal=True).collect()]
    assert lit == [1, 0]


def test_dataset_write_is_keyed_and_survives_a_broken_write(spark, tmp_path):
    from panelkit.sources.stores import dataset_write
    ds = spark.range(9).selectExpr("id", "'train' AS split")
    assert dataset_write(ds.limit(3), str(tmp_path), "three").count() == 3
    assert dataset_write(ds, str(tmp_path), "nine").count() == 9
    assert dataset_write(ds, str(tmp_path), "three").count() == 3          # kept
    for d in tmp_path.iterdir():
        marker = d / "_SUCCESS"
        marker.rename(d / "_gone")                                         # as a failed write leaves it
    assert dataset_write(ds, str(tmp_path), "three").count() == 9


def test_streamed_days_are_complete_over_several_batches(spark, tmp_path):
    from pyspark.sql import functions as F
    from panelkit.streaming.incremental import commit_days, ingest_new_days
    rows = spark.range(10).select(F.expr("date_add(date'2024-01-01', cast(id % 2 as int))").alias("date"), "id")
    rows.filter("date = '2024-01-01'").limit(1).write.partitionBy("date").parquet(f"{tmp_path}/store")
    rows.repartition(5).write.parquet(f"{tmp_path}/incoming")
    for _ in range(2):                                                      # a second run adds nothing
        ingest_new_days(spark, f"{tmp_path}/incoming", rows.schema, f"{tmp_path}/arrived", f"{tmp_path}/ckpt",
                        max_files_per_trigger=1).awaitTermination()
        store = commit_days(spark, f"{tmp_path}/arrived", f"{tmp_path}/store", f"{tmp_path}/base")
        assert sorted((str(r.date), r.n) for r in store.groupBy("date").agg(F.count("*").alias("n")).collect()) == [
            ("2024-01-01", 1), ("2024-01-02", 5)]


def test_strict_prices(spark):
    b = _bars(spark).withColumn("close", F_lit(2.0))
    ask = lambda t, day: spark.createDataFrame([(t, dt.date(2023, 8, day))], "ticker string, date date")
    assert B.price_asof(b, ask("AAPL", 5), strict=True).first().price == 2.0
    for t, day in (("MSFT", 5), ("AAPL", 30)):
        with pytest.raises(ValueError, match="no price"):
            B.price_asof(b, ask(t, day), strict=True)


def test_each_prompt_is_scored_once(spark, tmp_path):
    from panelkit.operators.predict import predict_batch
    calls = spark.sparkContext.accumulator(0)

    def scorer(model, prompt):
        calls.add(1)
        return " good " if prompt == "p1" else "odd"

    ask = spark.createDataFrame([("m", "p1"), ("m", "p1"), ("m", "p2"), ("m", "p3")], "model string, prompt string")
    cache = spark.createDataFrame([("m", "p3", "bad"), ("m", "p3", "bad")], "model string, prompt string, completion string")
    answers, fresh = predict_batch(ask, cache, scorer, ["good", "bad"], cache_path=f"{tmp_path}/cache")
    assert sorted((r.prompt, str(r.label)) for r in answers.collect()) == [("p1", "good"), ("p1", "good"), ("p2", "None"), ("p3", "bad")]
    assert fresh.count() == 2 and spark.read.parquet(f"{tmp_path}/cache").count() == 2 and calls.value == 2


def test_range_checks(spark):
    import datetime as dt
    from panelkit.operators.quality import range_checks
    d = dt.date
    store = spark.createDataFrame([(d(2031, 1, 5),), (d(2031, 2, 1),)], "date date")
    asked = spark.createDataFrame([(1, d(2031, 1, 1), d(2031, 1, 5)), (2, d(2031, 2, 2), d(2031, 3, 1)), (3, d(2031, 1, 9), d(2031, 1, 8)),
                                   (4, None, d(2031, 1, 9))], "id int, start date, end date")
    got = {r.id: (r.is_forwards, r.overlaps_store, r.is_answerable) for r in range_checks(asked, store).collect()}
    assert got == {1: (True, True, True), 2: (True, False, False), 3: (False, True, False), 4: (False, False, False)}
    assert {r.is_answerable for r in range_checks(asked, store.limit(0)).collect()} == {False}
