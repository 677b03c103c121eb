import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelkit.functions.columns import duration_text, float_list_text, py_str_repr, strip_ws
from panelkit.operators import predict as PD
from panelkit.operators import prompts as PT


def test_float_list_text_matches_python(spark):
    vals = [0.40625, 1.0, None, 2.718281828, 0.03125, 123.456789, 0.99995]
    df = spark.createDataFrame([(vals,)], "v array<double>")
    got = df.select(float_list_text("v").alias("t")).collect()[0].t
    assert got == ", ".join(f"{x:.4f}" if x is not None else "nan" for x in vals)


def test_float_list_text_exact_binary_rounding(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    ties = [-1.00005, 1.00005, 0.00015, 2.00025, 0.40625, -0.40625, 0.03125, 1.23455, -0.00001, -0.0, 0.0,
            123456.78905, 99999.99995]
    rand = list(rng.normal(size=400) * 10) + list(np.round(rng.normal(size=400), 5))
    vals = [float(x) for x in ties + rand]
    df = spark.createDataFrame([(vals,)], "v array<double>")
    got = df.select(float_list_text("v").alias("t")).collect()[0].t
    assert got == ", ".join(f"{x:.4f}" for x in vals)


@pytest.mark.parametrize("s", ["abc", "it's", 'say "x"', "both ' \"", "back\\slash", "nl\nx", "tab\tx"])
def test_py_str_repr(spark, s):
    df = spark.createDataFrame([(s,)], "t string")
    assert df.select(py_str_repr("t").alias("r")).collect()[0].r == repr(s)


def test_prompt_text_layout(spark):
    row = ("AAPL", [dt.date(2023, 8, 7), dt.date(2023, 8, 8)], ["Monday", "Tuesday"], [1.0, 1.5], [1.0, None],
           [1.0, None], [1.0, None], [1.0, None], [1.0, None], [["T1", "it's"], []], "good")
    df = spark.createDataFrame([row], "ticker string, date array<date>, weekday array<string>, "
                               "open array<double>, close array<double>, adj_close array<double>, "
                               "high array<double>, low array<double>, volume array<double>, "
                               "title array<array<string>>, target string")
    r = PT.prompt_build(df).collect()[0]
    pad = "\n            "
    exp = ("\n            Ticker: AAPL" + pad + "Weekdays: Monday, Tuesday" + pad + "Stock Data:"
           + pad + "- Open Prices: 1.0000, 1.5000" + pad + "- Close Prices: 1.0000, nan"
           + pad + "- Adjusted Close Prices: 1.0000, nan" + pad + "- High Prices: 1.0000, nan"
           + pad + "- Low Prices: 1.0000, nan" + pad + "- Volume: 1.0000, nan" + pad + "News Titles:"
           + pad + "['T1', \"it's\"]\n[]" + pad + "Predict the expected stock return for the next day:\n    ")
    assert r.prompt == exp
    assert r["index"] == "AAPL - 2023-08-08" and r.completion == "good\n"


def test_duration_text(spark):
    df = spark.createDataFrame([(0.4,), (59.0,), (3600.0,), (90061.5,), (90062.5,)], "s double")
    got = [r.t for r in df.select(duration_text("s").alias("t")).collect()]
    assert got == ["0s", "59s", "1h 0s", "1d 1h 1m 2s", "1d 1h 1m 2s"]


def test_strip_ws(spark):
    df = spark.createDataFrame([(" good\n",)], "c string")
    assert df.select(strip_ws("c").alias("x")).collect()[0].x == "good"


def test_ground_truth_labels(spark):
    df = spark.createDataFrame([("A", [dt.date(2023, 1, 2)], 0.1), ("B", [dt.date(2023, 1, 2)], -0.1),
                                ("C", [dt.date(2023, 1, 2)], 0.0), ("A", [dt.date(2023, 1, 2)], 0.1)],
                               "ticker string, date array<date>, return double")
    got = {r["index"]: r.label for r in PD.predict_ground_truth(df, ["bad", "neutral", "good"]).collect()}
    assert got == {"A - 2023-01-02": "good", "B - 2023-01-02": "bad", "C - 2023-01-02": "neutral"}


def test_predict_batch_cache_retries_and_labels(spark):
    calls = {"n": 0}

    def scorer(model, prompt):
        if prompt == "fail":
            raise RuntimeError("service down")
        return {"p1": " good\n", "p2": "weird"}[prompt]

    req = spark.createDataFrame([("m", "p0"), ("m", "p1"), ("m", "p2"), ("m", "fail"), ("m", "p1")],
                                "model string, prompt string")
    cache = spark.createDataFrame([("m", "p0", "bad")], "model string, prompt string, completion string")
    answers, fresh = PD.predict_batch(req, cache, PD.each(scorer), ["bad", "good"])
    got = {(r.prompt, r.completion, r.label) for r in answers.collect()}
    assert got == {("p0", "bad", "bad"), ("p1", "good", "good"), ("p2", "weird", None), ("fail", None, None)}
    assert {r.prompt for r in fresh.collect()} == {"p1", "p2"}       # failures are not cached
    assert PD.cache_misses(req, cache).count() == 3


def test_random_predictor_is_repeatable_and_uses_all_labels(spark):
    keys = spark.range(300).select(F.col("id").cast("string").alias("index"))
    a = PD.predict_random(keys, ["x", "y", "z"], seed=5)
    b = PD.predict_random(keys.repartition(7), ["x", "y", "z"], seed=5)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert {r.label for r in a.collect()} == {"x", "y", "z"}


def test_predict_batch_asks_in_batches_and_again_for_what_is_missing(spark):
    def scorer(model, prompts):
        assert len(prompts) <= 4
        if any(p == "boom" for p in prompts) and len(prompts) > 1:
            raise RuntimeError("one bad prompt fails the call")
        # every third prompt is answered on its own only
        return [None if int(p[1:]) % 3 == 0 and len(prompts) > 2 else f" {model}{p[1:]} " for p in prompts]

    req = spark.createDataFrame([("m", f"p{k}") for k in range(30)] + [("n", "p5"), (None, "p1"), ("m", None)],
                                "model string, prompt string").repartition(3)
    cache = spark.createDataFrame([], "model string, prompt string, completion string")
    answers, fresh = PD.predict_batch(req, cache, scorer, ["m1"], retries=40, size=4)
    got = {(r.model, r.prompt): (r.completion, r.label) for r in answers.collect()}
    assert got["m", "p1"] == ("m1", "m1") and got["n", "p5"] == ("n5", None)
    assert got[None, "p1"] == got["m", None] == (None, None)
    assert all(got["m", f"p{k}"][0] == f"m{k}" for k in range(30) if k % 3)
    assert fresh.count() == sum(c is not None for c, _ in got.values())
    with pytest.raises(Exception, match="2 answers"):
        PD.predict_batch(req, cache, lambda m, p: ["a", "b"], ["a"], size=4)


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 40, 47, 48, 60])
def test_tail_rows_cut_within_a_day(spark, n):
    days = [dt.date(2024, 1, 1)] * 7 + [dt.date(2024, 1, 2)] * 33 + [dt.date(2024, 1, 3)] * 8
    rows = [(d, f"T{k % 5}" if k % 11 else None, k % 3, k) for k, d in enumerate(days)] + [(None, "A", 0, 900), (None, "B", 1, 901)]
    df = spark.createDataFrame(rows, "date date, ticker string, replica int, k int").repartition(4)
    count = spark.createDataFrame([(n,)], "_n long")

    def place(r):
        return (r[0] or dt.date.min, r[1] is not None, r[1] or "", r[2])

    want = sorted((place(r) for r in rows), reverse=True)[:n]
    got = PD.tail_rows(df, count).collect()
    assert sorted((place(r) for r in got), reverse=True) == want
    assert len({r.k for r in got}) == len(got) and PD.tail_rows(df, count).columns == df.columns


def test_single_prompt_scorer_needs_no_wrapping(spark):
    ask = spark.createDataFrame([("m", f"p{k}") for k in range(9)], "model string, prompt string").coalesce(1)
    cache = spark.createDataFrame([], "model string, prompt string, completion string")
    answers, _ = PD.predict_batch(ask, cache, lambda model, prompt: f" {prompt} ", ["p1"])
    assert {(r.prompt, r.completion) for r in answers.collect()} == {(f"p{k}", f"p{k}") for k in range(9)}
