import duckdb
import pytest

from conftest import SF_SMALL

FAST_KEYS = ["price_slice", "calendar_fill", "weekend_ffill", "price_asof", "sliding_windows",
             "forward_return", "relative_scaling_first", "keyword_count", "daily_news_lists",
             "top_titles_per_day", "page_extract", "published_time_local", "nearest_vector",
             "order_checks", "n_day_return"]


def test_entry_runs_and_has_rows(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() > 0
    assert {"split", "ticker", "sample_id", "title", "return", "target"} <= set(df.columns)


def test_registry_consistent():
    from __spark_entry__ import oracle_sql, queries
    q, o = queries(), oracle_sql()
    assert len(q) >= 100 and set(o) <= set(q)


def _norm(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    return "NULL" if v is None else str(v)


@pytest.mark.parametrize("name", FAST_KEYS)
def test_oracle_small(spark, name):
    from __spark_entry__ import oracle_sql, queries
    df = queries()[name](spark, SF_SMALL)
    con = duckdb.connect()
    for t in ("events", "lineitem", "part", "documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    cur = con.execute(oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    key = sorted(cols)
    got = sorted(tuple(_norm(r[c]) for c in key) for r in df.collect())
    exp_rows = cur.fetchall()
    idx = [cols.index(c) for c in key]
    exp = sorted(tuple(_norm(r[i]) for i in idx) for r in exp_rows)
    assert got == exp


def _gathered(plan: str) -> list[str]:
    import re
    lines = plan.splitlines()
    return [lines[i - 1] for i, line in enumerate(lines)
            if "Exchange SinglePartition" in line and i > 0
            and not re.search(r"(HashAggregate|SortAggregate|ObjectHashAggregate)\(keys?=\[\]", lines[i - 1])]


@pytest.mark.parametrize("name", ["sliding_windows", "forward_return", "relative_scaling_first",
                                  "top_titles_per_day", "price_asof", "ledger_positions"])
def test_no_single_partition_gathering(spark, name):
    from __spark_entry__ import queries
    df = queries()[name](spark, SF_SMALL)
    assert _gathered(df._jdf.queryExecution().executedPlan().toString()) == []


def test_pipeline_samples_plan_is_partitioned(spark):
    from panelkit.params import Params
    from panelkit.plans.pipeline import samples
    from panelkit.sources import fixtures as FX
    p = Params(frames=FX.EVENT_FRAMES, keywords=FX.FIXTURE_KEYWORDS)
    s = samples(spark, FX.event_bars(spark, SF_SMALL), FX.event_news(spark, SF_SMALL), p)
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert _gathered(plan) == []
    assert "documents.parquet" not in plan          # text read once, into the stage table
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_slice_pushdown_on_stored_bars(spark, tmp_path):
    from panelkit.operators import bars as B
    from panelkit.sources import fixtures as FX
    FX.brand_bars(spark, SF_SMALL).write.parquet(str(tmp_path / "bars"))
    bars = spark.read.parquet(str(tmp_path / "bars"))
    plan = B.price_slice(bars, "1995-03-01", "1995-06-30", ["Brand#3"]).select("date", "close") \
        ._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "GreaterThanOrEqual(date" in scan and "LessThanOrEqual(date" in scan
    assert "[date#" in scan and "open#" not in scan and "volume#" not in scan   # pruned columns
