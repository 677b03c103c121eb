import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from panelkit.operators.profiling import titles_per_window_histogram
from panelkit.params import Params
from panelkit.plans.pipeline import build_dataset, samples
from panelkit.sources import fixtures as FX


@pytest.fixture(scope="module")
def dataset(spark):
    p = Params(frames=FX.EVENT_FRAMES, keywords=FX.FIXTURE_KEYWORDS)
    ds = build_dataset(spark, FX.event_bars(spark, SF_SMALL), FX.event_news(spark, SF_SMALL), p)
    return p, ds.toPandas()


def test_every_sample_is_well_formed(dataset):
    p, pdf = dataset
    assert set(pdf["split"]) == {"train", "val", "test"}
    assert set(pdf.loc[pdf.split == "train", "replica"]) == {0, 1}
    assert set(pdf.loc[pdf.split != "train", "replica"]) == {0}
    for _, r in pdf.iterrows():
        dates = list(r["date"])
        assert len(dates) == p.lookback
        assert all((b - a).days == 1 for a, b in zip(dates, dates[1:]))
        assert list(r["weekday"]) == [d.strftime("%A") for d in dates]
        assert r["open"][0] == pytest.approx(1.0) or r["open"][0] != r["open"][0]   # relative to first
        for c in p.drop_features_for_last_day:
            assert r[c][-1] is None or r[c][-1] != r[c][-1]                         # masked last day
        titles = list(r["title"])
        assert all(len(t) <= p.max_titles_per_day for t in titles)
        assert sum(len(t) for t in titles) >= p.min_titles_per_window
        assert len(titles[-1]) > 0
        assert r["target"] in p.labels


def test_eval_titles_are_deterministic_and_train_draws_repeatable(spark, dataset):
    p, pdf = dataset
    again = build_dataset(spark, FX.event_bars(spark, SF_SMALL), FX.event_news(spark, SF_SMALL), p).toPandas()
    key = ["split", "ticker", "sample_id", "replica"]
    a = pdf.sort_values(key).reset_index(drop=True)
    b = again.sort_values(key).reset_index(drop=True)
    assert [list(map(list, t)) for t in a["title"]] == [list(map(list, t)) for t in b["title"]]


def test_null_guard_fails_on_sparse_brand_bars(spark):
    # sf0.001 brand bars are too sparse: most targets fall outside the bins
    p = Params(frames=FX.BRAND_FRAMES, keywords=FX.FIXTURE_KEYWORDS)
    with pytest.raises(ValueError):
        build_dataset(spark, FX.brand_bars(spark, SF_SMALL), FX.dated_news(spark, SF_SMALL), p)


def _joined_unions(node, under_join=False):
    """Names of unions whose own dealing a join above relies on."""
    name, kids = node.nodeName(), node.children()
    found = ["Union"] if name == "Union" and under_join else []
    under = ("Join" in name or under_join) and "Exchange" not in name
    for i in range(kids.size()):
        found += _joined_unions(kids.apply(i), under)
    return found


def test_day_lists_meet_the_windows_without_a_union_as_a_joins_side(spark):
    # a union counts as dealt by the hash of its sides; cut unlike, they can't be zipped (sf0.1 and up)
    days = [dt.date(2020, 1, 6) + dt.timedelta(i) for i in range(8)]
    frame = FX.frames(*((s, "2020-01-06", "2020-01-13") for s in ("train", "val", "test")))
    bars = spark.createDataFrame([(d, "A", *[float(i + 1)] * 6) for i, d in enumerate(days)],
                                 "date date, ticker string, open double, high double, low double, close double, adj_close double, volume double")
    n_news = [0, 1, 2, 3, 4, 1, 5, 2]
    news = spark.createDataFrame([(d, f"u{i}-{j}", "s", f"t{i}-{j}", "the", 10 * i + j) for i, (d, n) in enumerate(zip(days, n_news)) for j in range(n)],
                                 "date date, url string, source string, title string, article string, ord long")
    p = Params(frames=frame, keywords=("the",), lookback=3, max_titles_per_day=2, min_titles_per_window=0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s = samples(spark, bars, news, p, title_filters=False)
        assert _joined_unions(s._jdf.queryExecution().executedPlan().initialPlan()) == []
        rows = s.select("split", "sample_id", "replica", "date", "title").collect()
        h = {r["bin"]: r["n"] for r in titles_per_window_histogram(s, 4).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == (2 + 1 + 1) * 5                  # five windows, two replicas of a training window
    for r in rows:
        assert [len(t) for t in r["title"]] == [min(2, n_news[days.index(d)]) for d in r["date"]]
        assert all(len(set(t)) == len(t) and all(x.startswith(f"t{days.index(d)}-") for x in t) for t, d in zip(r["title"], r["date"]))
    totals = [sum(min(2, n) for n in n_news[i:i + 3]) for i in range(5)]
    lo, hi = min(totals), max(totals)
    expected = {}
    for t in totals:
        b = min(int((t - lo) / ((hi - lo) / 4)), 3)
        expected[b] = expected.get(b, 0) + 4
    assert h == expected
