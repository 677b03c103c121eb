"""Catalog: the dataset pipeline, title selection and target binning.

The flagship oracle rebuilds the whole preprocessing in SQL on brand_bars with
the three fixture frames, which cover the bars' whole span.  Training titles are random draws, so the value
check covers everything except their text (their number per day is fixed:
min(candidates, k)).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import news as N
from ..operators import profiling as PR
from ..operators import targets as TG
from ..operators import titles as TT
from ..params import Params
from ..sources import fixtures as FX
from ..session import stage_path, stage_table
from . import oracle_sql as S
from .catalog import query, r6
from .pipeline import build_dataset, label, samples

FEATS = ("open", "high", "low", "close", "adj_close", "volume")
MASKED = ("close", "adj_close", "high", "low", "volume")
LABELS = ("very bad", "bad", "neutral", "good", "very good")
L, K, REPS, MIN_T = 5, 2, 2, 5


def brand_params(**kw) -> Params:
    return Params(frames=FX.BRAND_FRAMES, keywords=FX.FIXTURE_KEYWORDS, **kw)


def flagship(spark, sf):
    """Smoke entry: event bars with three equal frames (30 dense days)."""
    p = Params(frames=FX.EVENT_FRAMES, keywords=FX.FIXTURE_KEYWORDS)
    return build_dataset(spark, FX.event_bars(spark, sf), FX.event_news(spark, sf), p)


def _dataset(spark, sf, **kw):
    return build_dataset(spark, FX.brand_bars(spark, sf), FX.daily_news(spark, sf), brand_params(**kw))


# --------------------------------------------------------------------------
# SQL of the whole preprocessing (CTEs), shared by several keys.

def _ref(c):
    last = L - 1 if c in MASKED else L
    return f"arg_min({c}, day_idx) FILTER (WHERE day_idx < {last} AND {c} IS NOT NULL) AS ref_{c}"


PIPE_SQL = S.with_(bars=S.BRAND_BARS, f=S.frames_values(S.BRAND_FRAMES), news=S.DAILY_NEWS)[:-1] + f""",
b AS (SELECT f.split, bars.* FROM bars JOIN f ON bars.date BETWEEN f.fstart AND f.fend),
bo AS (SELECT split, min(date) AS lo, max(date) AS hi FROM b GROUP BY split),
grid AS (SELECT t.split, t.ticker, CAST(unnest(generate_series(bo.lo, bo.hi, INTERVAL 1 DAY)) AS DATE) AS date
         FROM (SELECT DISTINCT split, ticker FROM b) t JOIN bo USING (split)),
p AS (SELECT g.split, g.ticker, g.date, b.open, b.high, b.low, b.close, b.adj_close, b.volume,
        datediff('day', bo.lo, g.date) AS pos, datediff('day', bo.lo, bo.hi) + 1 AS n
      FROM grid g JOIN bo USING (split) LEFT JOIN b USING (split, ticker, date)),
lw AS (SELECT p.*, p.pos - r.range AS sample_id, r.range AS day_idx
       FROM p JOIN range(0, {L + 1}) r ON p.pos - r.range BETWEEN 0 AND p.n - {L + 1}),
rep AS (SELECT lw.*, rr.range AS replica FROM lw JOIN range(0, {REPS}) rr ON (lw.split = 'train' OR rr.range = 0)),
agg AS (SELECT split, ticker, sample_id, replica,
   count(*) FILTER (WHERE day_idx = {L} AND open IS NOT NULL) > 0 AS valid,
   arg_max(open, day_idx) FILTER (WHERE day_idx < {L} AND open IS NOT NULL) AS buy,
   arg_max(open, day_idx) FILTER (WHERE day_idx >= {L} AND open IS NOT NULL) AS sell,
   {", ".join(_ref(c) for c in FEATS)}
 FROM rep GROUP BY split, ticker, sample_id, replica),
nk AS (SELECT date, ord, title, {S.kw_count()} AS kc FROM news),
cand AS (SELECT f.split, nk.date, nk.ord, nk.title, nk.kc FROM nk JOIN f ON nk.date BETWEEN f.fstart AND f.fend
         WHERE nk.kc > 0 AND nk.title IS NOT NULL),
cnt AS (SELECT split, date, count(*) AS m FROM cand GROUP BY split, date),
ranked AS (SELECT c.*, row_number() OVER (PARTITION BY split, date ORDER BY kc DESC, title DESC, ord) AS rk FROM cand c),
dayl AS (SELECT r.split, r.date, least(cnt.m, {K}) AS n_day,
           CASE WHEN r.split = 'train' AND cnt.m > {K} THEN NULL
                ELSE string_agg(r.title, ' | ' ORDER BY CASE WHEN cnt.m <= {K} THEN r.ord ELSE r.rk END) END AS titles_text,
           CASE WHEN r.split = 'train' AND cnt.m > {K} THEN NULL
                ELSE string_agg({S.py_repr_sql('r.title')}, ', ' ORDER BY CASE WHEN cnt.m <= {K} THEN r.ord ELSE r.rk END) END AS titles_repr
         FROM ranked r JOIN cnt USING (split, date) WHERE r.rk <= {K} GROUP BY r.split, r.date, cnt.m),
x AS (SELECT rep.split, rep.ticker, rep.sample_id, rep.replica, rep.day_idx, rep.date,
        {", ".join(f"CASE WHEN day_idx = {L - 1} THEN NULL ELSE {c} END AS {c}" if c in MASKED else c for c in FEATS)},
        coalesce(dl.n_day, 0) AS n_day, dl.titles_text, dl.titles_repr
      FROM rep LEFT JOIN dayl dl USING (split, date) WHERE rep.day_idx < {L}),
win AS (SELECT a.*, a.sell / NULLIF(a.buy, 0) - 1 AS ret, t.n_titles
        FROM agg a JOIN (SELECT split, ticker, sample_id, replica, sum(n_day) AS n_titles,
                          max(CASE WHEN day_idx = {L - 1} THEN n_day END) AS last_n
                         FROM x GROUP BY split, ticker, sample_id, replica) t
          USING (split, ticker, sample_id, replica)
        WHERE a.valid AND t.n_titles >= {MIN_T} AND t.last_n > 0),
edges AS (SELECT list_sort(list_distinct(quantile_cont(ret, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e
          FROM win WHERE split = 'train'),
lab AS (SELECT win.*, CASE WHEN ret > e[1] AND ret <= e[len(e)]
              THEN {S.labels_sql(LABELS)}[len(list_filter(e, lambda v: v < ret))] END AS target
        FROM win, edges),
fin AS (SELECT * FROM lab WHERE target IS NOT NULL)"""


def _sample_rows_sql():
    cols = ", ".join(f"round(x.{c} / NULLIF(fin.ref_{c}, 0), 6) AS {c}" for c in FEATS)
    return PIPE_SQL + f"""
SELECT fin.split, fin.ticker, fin.sample_id, fin.replica, x.day_idx, x.date, dayname(x.date) AS weekday,
  {cols}, x.n_day, CASE WHEN fin.split = 'train' THEN NULL ELSE x.titles_text END AS titles_text,
  round(fin.ret, 6) AS ret, fin.target
FROM fin JOIN x USING (split, ticker, sample_id, replica)"""


def _explode_samples(ds):
    z = ds.select("split", "ticker", "sample_id", "replica", "return", "target",
                  F.posexplode(F.arrays_zip("date", "weekday", *FEATS, "title")).alias("day_idx", "z"))
    return z.select("split", "ticker", "sample_id", "replica", "day_idx", "z.date", "z.weekday",
                    *[r6(f"z.{c}").alias(c) for c in FEATS],
                    F.size("z.title").cast("bigint").alias("n_day"),
                    F.when((F.col("split") == "train") | (F.size("z.title") == 0), F.lit(None))
                    .otherwise(F.array_join("z.title", " | ")).alias("titles_text"),
                    r6("return").alias("ret"), "target")


@query("build_dataset", _sample_rows_sql())
def build_dataset_q(spark, sf):
    return _explode_samples(_dataset(spark, sf))


_SAMPLE_SQL = PIPE_SQL + """
SELECT split, ticker, sample_id, replica, CAST(n_titles AS BIGINT) AS n_titles, round(ret, 6) AS ret, target FROM fin"""


def _sample_cols(ds):
    from ..operators.titles import titles_per_window
    return ds.select("split", "ticker", "sample_id", "replica",
                     titles_per_window("title").cast("bigint").alias("n_titles"),
                     r6("return").alias("ret"), "target")


@query("dataset_write", _SAMPLE_SQL)
def dataset_write(spark, sf):
    from ..sources.stores import dataset_write as write
    back = write(_dataset(spark, sf), stage_path(spark, "datasets"), f"{sf} {brand_params()}")
    return _sample_cols(back)


@query("union_splits", PIPE_SQL + """
SELECT DISTINCT split, ticker, sample_id, round(ret, 6) AS ret, target FROM fin""")
def union_splits(spark, sf):
    ds = _dataset(spark, sf)
    parts = [ds.filter(F.col("split") == s).select("split", "ticker", "sample_id", r6("return").alias("ret"),
                                                    "target") for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


# ---- stages of the title cut ------------------------------------------------

@query("titles_nonzero", S.with_(news=S.DAILY_NEWS) + f"""
SELECT date, ord, title, {S.kw_count()} AS keywords_count FROM news
WHERE {S.kw_count()} > 0 AND title IS NOT NULL""")
def titles_nonzero(spark, sf):
    n = N.keyword_count(FX.daily_news(spark, sf), FX.FIXTURE_KEYWORDS)
    return TT.titles_nonzero(n).select("date", "ord", "title", "keywords_count")


@query("top_titles_per_day", S.with_(news=S.DAILY_NEWS) + f""",
cand AS (SELECT date, ord, title, {S.kw_count()} AS kc FROM news WHERE {S.kw_count()} > 0 AND title IS NOT NULL),
cnt AS (SELECT date, count(*) AS m FROM cand GROUP BY date),
ranked AS (SELECT c.*, row_number() OVER (PARTITION BY date ORDER BY kc DESC, title DESC, ord) AS rk FROM cand c)
SELECT r.date, r.title, CASE WHEN cnt.m <= 3 THEN row_number() OVER (PARTITION BY r.date ORDER BY r.ord) ELSE r.rk END - 1 AS pos
FROM ranked r JOIN cnt USING (date) WHERE r.rk <= 3""")
def top_titles_per_day(spark, sf):
    n = N.keyword_count(FX.daily_news(spark, sf), FX.FIXTURE_KEYWORDS)
    top = TT.top_titles_per_day(TT.titles_nonzero(n), 3)
    return top.select("date", F.posexplode("titles").alias("pos", "title")).select(
        "date", "title", F.col("pos").cast("bigint").alias("pos"))


@query("sample_titles_per_day", PIPE_SQL + """
SELECT fin.ticker, fin.sample_id, fin.replica, CAST(x.day_idx AS BIGINT) AS day_idx, CAST(coalesce(x.n_day, 0) AS BIGINT) AS n_titles
FROM fin JOIN x USING (split, ticker, sample_id, replica) WHERE fin.split = 'train'""")
def sample_titles_per_day(spark, sf):
    """How many titles each training window-day has drawn (which ones is random)."""
    train = _dataset(spark, sf).filter(F.col("split") == "train")
    t = train.select("ticker", "sample_id", "replica", F.posexplode("title").alias("day_idx", "titles"))
    return t.select("ticker", "sample_id", "replica", F.col("day_idx").cast("bigint").alias("day_idx"),
                    F.size("titles").cast("bigint").alias("n_titles"))


@query("replicate_samples", PIPE_SQL + """
SELECT split, replica, count(*) AS n FROM fin GROUP BY split, replica""")
def replicate_samples(spark, sf):
    return _dataset(spark, sf).groupBy("split", "replica").agg(F.count(F.lit(1)).alias("n"))


def _pre_filter_sql(final: str) -> str:
    return PIPE_SQL.split(",\nwin AS")[0] + f""",
pre AS (SELECT a.split, a.ticker, a.sample_id, a.replica, t.n_titles, t.last_n
        FROM agg a JOIN (SELECT split, ticker, sample_id, replica, sum(n_day) AS n_titles,
                          max(CASE WHEN day_idx = {L - 1} THEN n_day END) AS last_n
                         FROM x GROUP BY split, ticker, sample_id, replica) t
          USING (split, ticker, sample_id, replica) WHERE a.valid)
{final}"""


def _pre_filter(spark, sf):
    return samples(spark, FX.brand_bars(spark, sf), FX.daily_news(spark, sf),
                   brand_params(min_titles_per_window=0), title_filters=False)


@query("titles_per_window", _pre_filter_sql(
    "SELECT split, ticker, sample_id, replica, CAST(n_titles AS BIGINT) AS n_titles FROM pre"))
def titles_per_window(spark, sf):
    return _pre_filter(spark, sf).select("split", "ticker", "sample_id", "replica",
                                         TT.titles_per_window("title").cast("bigint").alias("n_titles"))


@query("min_titles_filter", _pre_filter_sql(
    f"SELECT split, ticker, sample_id, replica FROM pre WHERE n_titles >= {MIN_T}"))
def min_titles_filter(spark, sf):
    return TT.min_titles_filter(_pre_filter(spark, sf), MIN_T).select("split", "ticker", "sample_id", "replica")


@query("last_day_titles_filter", _pre_filter_sql(
    "SELECT split, ticker, sample_id, replica FROM pre WHERE last_n > 0"))
def last_day_titles_filter(spark, sf):
    return TT.last_day_titles_filter(_pre_filter(spark, sf)).select("split", "ticker", "sample_id", "replica")


@query("titles_per_window_histogram", _pre_filter_sql("""SELECT bin, count(*) AS n FROM (
  SELECT CASE WHEN mx = mn THEN 0 ELSE least(CAST(floor((n_titles - mn) / ((mx - mn) / 10.0)) AS INTEGER), 9) END AS bin
  FROM pre, (SELECT min(n_titles) AS mn, max(n_titles) AS mx FROM pre)) GROUP BY bin"""))
def titles_per_window_histogram(spark, sf):
    h = PR.titles_per_window_histogram(_pre_filter(spark, sf), 10)
    return h.select("bin", "n")


def _samples(spark, sf):
    """Written once: edges, labels and guard each read them several times."""
    return stage_table(samples(spark, FX.brand_bars(spark, sf), FX.daily_news(spark, sf), brand_params())
                       .select("split", "ticker", "sample_id", "replica", "return"), "samples")


# ---- binning ------------------------------------------------------------------

@query("equal_frequency_edges", PIPE_SQL.split(",\nedges AS")[0] + """
SELECT unnest(e) AS edge FROM (SELECT list_sort(list_distinct(quantile_cont(ret, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e
  FROM win WHERE split = 'train')""".replace("SELECT unnest(e) AS edge", "SELECT round(unnest(e), 6) AS edge"))
def equal_frequency_edges(spark, sf):
    s = _samples(spark, sf)
    e = TG.equal_frequency_edges(s.filter(F.col("split") == "train"), 5)
    return e.select(F.explode("edges").alias("edge")).select(r6("edge").alias("edge"))


@query("equal_width_edges", PIPE_SQL.split(",\nedges AS")[0] + """,
mm AS (SELECT min(ret) AS mn, max(ret) AS mx FROM win WHERE split = 'train'),
e AS (SELECT unnest(range(0, 6)) AS i, mn, mx FROM mm)
SELECT i, round(CASE WHEN i = 5 THEN mx WHEN i = 0 THEN mn - (mx - mn) * 0.001 ELSE mn + i * ((mx - mn) / 5.0) END, 6) AS edge
FROM e""")
def equal_width_edges(spark, sf):
    s = _samples(spark, sf)
    e = TG.equal_width_edges(s.filter(F.col("split") == "train"), 5)
    return e.select(F.posexplode("edges").alias("i", "edge")).select(F.col("i").cast("bigint").alias("i"),
                                                                    r6("edge").alias("edge"))


@query("apply_bins", PIPE_SQL + """
SELECT split, ticker, sample_id, replica, round(ret, 6) AS ret, target FROM lab""")
def apply_bins(spark, sf):
    s = _samples(spark, sf)
    return label(s, brand_params()).select("split", "ticker", "sample_id", "replica",
                                           r6("return").alias("ret"), "target")


@query("null_target_guard", PIPE_SQL + """
SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE target IS NULL) AS n_null FROM lab GROUP BY split""")
def null_target_guard(spark, sf):
    s = _samples(spark, sf)
    lab = label(s, brand_params())
    TG.null_target_guard(lab, 0.05, splits=["train", "val", "test"])   # raises when over the limit
    return TG.null_target_counts(lab)


@query("return_histogram_by_target", PIPE_SQL + """,
mm AS (SELECT min(ret) AS mn, max(ret) AS mx, count(*) AS tot FROM fin WHERE split = 'train'),
hb AS (SELECT target, CASE WHEN mx = mn THEN 0 ELSE least(CAST(floor((ret - mn) / ((mx - mn) / 50.0)) AS INTEGER), 49) END AS bin, tot
       FROM fin, mm WHERE split = 'train')
SELECT target, bin, round(count(*) * 100.0 / any_value(tot), 6) AS pct FROM hb GROUP BY target, bin""")
def return_histogram_by_target(spark, sf):
    from ..operators.targets import return_histogram_by_target as rh
    ds = _dataset(spark, sf).filter(F.col("split") == "train")
    return rh(ds, 50).select("target", "bin", r6("pct").alias("pct"))


@query("return_bin_target_freq", PIPE_SQL + """,
mm AS (SELECT min(ret) AS mn, max(ret) AS mx FROM fin WHERE split = 'train'),
bins AS (SELECT unnest(range(0, 30)) AS bin),
tg AS (SELECT DISTINCT target FROM fin WHERE split = 'train'),
hb AS (SELECT target, CASE WHEN ret <= mn THEN 0 ELSE
         least(CAST(ceil((ret - mn) / ((mx - mn) / 30.0)) AS INTEGER) - 1, 29) END AS bin FROM fin, mm WHERE split = 'train'),
c AS (SELECT target, bin, count(*) AS n FROM hb GROUP BY target, bin)
SELECT bins.bin, tg.target, coalesce(c.n, 0) AS n FROM bins CROSS JOIN tg LEFT JOIN c ON c.bin = bins.bin AND c.target = tg.target""")
def return_bin_target_freq(spark, sf):
    from ..operators.targets import return_bin_target_freq as rb
    ds = _dataset(spark, sf).filter(F.col("split") == "train")
    return rb(ds, 30).select("bin", "target", "n")
