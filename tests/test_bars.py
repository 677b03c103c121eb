import datetime as dt

import numpy as np
import pandas as pd
import pytest

from panelkit.operators import bars as B


def _bars(spark, rows):
    return spark.createDataFrame(rows, "date date, ticker string, open double, close double")


def test_price_slice_inclusive(spark):
    d0 = dt.date(2023, 8, 1)
    df = _bars(spark, [(d0 + dt.timedelta(i), t, 1.0, 1.0) for i in range(10) for t in ("AAPL", "GOOGL")])
    out = B.price_slice(df, "2023-08-02", "2023-08-04", "AAPL").collect()
    assert sorted(r.date.day for r in out) == [2, 3, 4] and {r.ticker for r in out} == {"AAPL"}


def test_price_asof_steps_back_over_gaps_and_years(spark):
    rows = [(dt.date(2022, 12, 30), "A", 1.0, 10.0), (dt.date(2023, 1, 3), "A", 2.0, 20.0),
            (dt.date(2023, 1, 5), "A", None, 30.0), (dt.date(2023, 1, 2), "B", 5.0, 50.0)]
    req = spark.createDataFrame([("A", dt.date(2023, 1, 1)), ("A", dt.date(2023, 1, 4)),
                                 ("A", dt.date(2023, 1, 6)), ("B", dt.date(2023, 1, 1)),
                                 ("A", dt.date(2022, 12, 1))], "ticker string, date date")
    out = {(r.ticker, r.date): r.price for r in B.price_asof(_bars(spark, rows), req, "close").collect()}
    assert out[("A", dt.date(2023, 1, 1))] == 10.0      # previous year's last bar
    assert out[("A", dt.date(2023, 1, 4))] == 20.0
    assert out[("A", dt.date(2023, 1, 6))] == 20.0      # incomplete bar on the 5th is skipped
    assert out[("B", dt.date(2023, 1, 1))] is None      # nothing before
    assert out[("A", dt.date(2022, 12, 1))] is None


def test_weekend_ffill_matches_pandas_reindex(spark):
    rows = [(dt.date(2023, 1, 2), "A", 1.0, 1.5), (dt.date(2023, 1, 2), "B", 2.0, 2.5),
            (dt.date(2023, 1, 3), "A", 3.0, 3.5), (dt.date(2023, 1, 6), "B", 4.0, 4.5)]
    out = B.weekend_ffill(_bars(spark, rows), "2023-01-01", "2023-01-09").toPandas()
    wide = pd.DataFrame(rows, columns=["date", "ticker", "open", "close"]).pivot(
        index="date", columns="ticker", values=["open", "close"])
    wide.index = pd.to_datetime(wide.index)
    filled = wide.reindex(pd.date_range("2023-01-01", "2023-01-09"), method="ffill")
    exp = filled.stack(future_stack=True).dropna(how="all").reset_index()
    exp = exp.rename(columns={"level_0": "date"})[["date", "ticker", "open", "close"]]
    got = out.assign(date=pd.to_datetime(out["date"])).sort_values(["date", "ticker"]).reset_index(drop=True)
    exp = exp.sort_values(["date", "ticker"]).reset_index(drop=True)
    assert len(got) == len(exp)
    assert np.allclose(got["open"], exp["open"]) and np.allclose(got["close"], exp["close"])


def test_growth_series_matches_numpy(spark):
    out = B.growth_series(spark, "2023-01-01", "2023-03-31").orderBy("date").toPandas()
    dates = pd.date_range("2023-01-01", "2023-03-31", freq="B")
    r = 1.1 ** (1 / 252) - 1
    assert list(pd.to_datetime(out["date"])) == list(dates)
    assert np.allclose(out["open"], (1 + r) ** np.arange(len(dates)))


def test_pivot_detects_duplicates(spark):
    long = spark.createDataFrame([(dt.date(2023, 1, 2), "Open", "A", 1.0),
                                  (dt.date(2023, 1, 2), "Open", "A", 2.0)],
                                 "date date, metric string, ticker string, value double")
    with pytest.raises(Exception):
        B.price_pivot_bars(long).collect()


def test_pivot_unpivot_round_trip(spark):
    rows = [(dt.date(2023, 1, 2), "A", 1.0, 2.0), (dt.date(2023, 1, 2), "B", 3.0, 4.0)]
    wide = B.price_pivot_wide(_bars(spark, rows), ["A", "B"], ["open", "close"])
    long = B.price_unpivot(wide, ["open", "close"])
    back = B.price_pivot_bars(long.withColumn("metric", long.metric), ["open", "close"])
    assert sorted((r.ticker, r.open, r.close) for r in back.collect()) == [("A", 1.0, 2.0), ("B", 3.0, 4.0)]


def test_n_day_return_pads_nulls_forward(spark):
    rows = [(dt.date(2023, 1, i + 1), "A", 1.0, v) for i, v in enumerate([1.0, 2.0, None, 4.0])]
    df = _bars(spark, rows).withColumnRenamed("close", "adj_close")
    got = [r.ret for r in B.n_day_return(df, 1).orderBy("date").collect()]
    s = pd.Series([1.0, 2.0, None, 4.0]).ffill()
    assert np.allclose(got, s.pct_change(1).dropna().tolist())
