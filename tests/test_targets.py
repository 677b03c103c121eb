import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkit.operators import targets as TG


def _ret(spark, vals, split="train"):
    return spark.createDataFrame([(split, float(v) if v is not None else None) for v in vals],
                                 "split string, return double")


def test_equal_frequency_edges_match_qcut_with_ties(spark):
    rng = np.random.default_rng(3)
    vals = np.round(rng.normal(size=997), 2)
    e = TG.equal_frequency_edges(_ret(spark, vals), 5).collect()[0].edges
    _, bins = pd.qcut(pd.Series(vals), q=5, retbins=True, duplicates="drop")
    assert np.allclose(e, bins)


def test_apply_bins_right_closed_minimum_and_out_of_range(spark):
    train = _ret(spark, [1, 2, 3, 4, 5, 6])
    edges = TG.equal_frequency_edges(train, 3)
    labels = ["bad", "neutral", "good"]
    lab = {r["return"]: r.target for r in TG.apply_bins(train, edges, labels).collect()}
    assert lab[1.0] is None                       # the minimum is outside (a, b]
    bins = pd.IntervalIndex.from_breaks(pd.qcut(pd.Series([1, 2, 3, 4, 5, 6.0]), 3, retbins=True)[1])
    for v in (2, 3, 4, 5, 6):
        i = bins.get_indexer([float(v)])[0]
        assert lab[float(v)] == labels[i]
    val = _ret(spark, [0.5, 7, None, 3.5], "val")
    got = {r["return"]: r.target for r in TG.apply_bins(val, edges, labels).collect()}
    assert got[0.5] is None and got[7.0] is None and got[None] is None and got[3.5] == "neutral"


def test_equal_frequency_duplicate_edges_dropped(spark):
    e = TG.equal_frequency_edges(_ret(spark, [1, 1, 1, 1, 2]), 4).collect()[0].edges
    assert e == [1.0, 2.0]


def test_equal_width_edges_match_pandas_cut(spark):
    vals = [0.3, -1.2, 4.4, 2.0]
    e = TG.equal_width_edges(_ret(spark, vals), 3).collect()[0].edges
    _, bins = pd.cut(pd.Series(vals), bins=3, retbins=True)
    assert np.allclose(e, bins)
    same = TG.equal_width_edges(_ret(spark, [2.0, 2.0]), 2).collect()[0].edges
    _, b2 = pd.cut(pd.Series([2.0, 2.0]), bins=2, retbins=True)
    assert np.allclose(same, b2)


def test_null_target_guard(spark):
    rows = [("train", "a")] * 96 + [("train", None)] * 4 + [("val", "a")] * 10 + [("val", None)]
    df = spark.createDataFrame(rows, "split string, target string")
    with pytest.raises(ValueError, match="val target nulls"):
        TG.null_target_guard(df, 0.05)
    ok = TG.null_target_guard(df.filter(F.col("split") == "train"), 0.05)
    assert ok.count() == 96


@pytest.mark.parametrize("kind", ["normal", "ties", "tiny"])
def test_distributed_quantiles_exact(spark, kind):
    rng = np.random.default_rng(5)
    if kind == "normal":
        vals = rng.normal(size=20000)
    elif kind == "ties":                      # a third of all rows share one value
        vals = np.concatenate([np.zeros(7000), np.round(rng.normal(size=14000), 3)])
    else:
        vals = np.array([3.0, 1.0, 2.0])
    probs = [0, 0.2, 0.4, 0.6, 0.8, 1.0]
    got = TG.distributed_quantiles(_ret(spark, vals), probs, buckets=16).collect()[0].q
    assert np.allclose(got, np.quantile(vals, probs), rtol=0, atol=1e-12)
    e = TG.equal_frequency_edges(_ret(spark, vals), 5).collect()[0].edges
    _, bins = pd.qcut(pd.Series(vals), q=5, retbins=True, duplicates="drop")
    assert np.allclose(e, bins, rtol=0, atol=1e-12)
