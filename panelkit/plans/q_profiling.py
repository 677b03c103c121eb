"""Catalog: profiling aggregates, histograms, similarity search, string checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import duration_text as dur
from ..operators import bars as B
from ..operators import profiling as PR
from ..operators import quality as Q
from ..operators import targets as TG
from ..sources import fixtures as FX
from . import oracle_sql as S
from .catalog import query, r6
from .q_bars import N_DAYS, _GRID_SQL

CLEAN = "SELECT date, url, source, title, article, ord FROM n WHERE title IS NOT NULL AND article IS NOT NULL"


def _news(spark, sf):
    return FX.dated_news(spark, sf)


@query("article_counts_by_period", S.with_(n=S.DATED_NEWS, c=CLEAN) + " UNION ALL ".join(
    f"SELECT '{g}' AS grain, {p} AS period, count(*) AS n_articles FROM c GROUP BY 2"
    for g, p in (("day", "date"), ("week", "CAST(date_trunc('week', date) AS DATE)"),
                 ("month", "CAST(date_trunc('month', date) AS DATE)"),
                 ("year", "CAST(date_trunc('year', date) AS DATE)"))))
def article_counts_by_period(spark, sf):
    return PR.article_counts_by_period(_news(spark, sf))


@query("daily_count_histogram", S.with_(n=S.DATED_NEWS, c=CLEAN) + """,
d AS (SELECT date, count(*) AS v FROM c GROUP BY date),
mm AS (SELECT min(v) AS mn, max(v) AS mx FROM d)
SELECT bin, count(*) AS n FROM (SELECT CASE WHEN mx = mn THEN 0
  ELSE least(CAST(floor((v - mn) / ((mx - mn) / 20.0)) AS INTEGER), 19) END AS bin FROM d, mm) GROUP BY bin""")
def daily_count_histogram(spark, sf):
    return PR.equal_bins(PR.daily_counts(_news(spark, sf)), "daily_count", 20).select("bin", "n")


_COLS = ("date", "url", "source", "title", "article", "ord")


@query("null_profile", S.with_(n=S.DATED_NEWS) + "SELECT count(*) AS rows_before, count(*) FILTER (WHERE "
       + " AND ".join(f"{c} IS NOT NULL" for c in _COLS) + ") AS rows_after, "
       + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in _COLS)
       + ", count(*) - count(*) FILTER (WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _COLS)
       + ") AS rows_dropped FROM n")
def null_profile(spark, sf):
    return Q.null_profile(_news(spark, sf).select(*_COLS))


@query("source_distribution", S.with_(n=S.DATED_NEWS, c=CLEAN) + """
SELECT source, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM c GROUP BY source""")
def source_distribution(spark, sf):
    return PR.source_distribution(_news(spark, sf)).select("source", "n", r6("pct").alias("pct"))


def _wc(c):
    return f"len(list_filter(regexp_split_to_array(coalesce({c}, ''), '\\s+'), lambda w: w <> ''))"


@query("word_count_averages", S.with_(n=S.DATED_NEWS, c=CLEAN) + f"""
SELECT CAST(trunc(avg({_wc('title')})) AS INTEGER) AS avg_title_words,
       CAST(trunc(avg({_wc('article')})) AS INTEGER) AS avg_article_words FROM c""")
def word_count_averages(spark, sf):
    return PR.word_count_averages(_news(spark, sf))


@query("word_counts_by_weekday", S.with_(n=S.DATED_NEWS, c=CLEAN) + f""",
g AS (SELECT dayname(date) AS weekday, avg({_wc('title')}) AS t, avg({_wc('article')}) AS a FROM c GROUP BY 1),
d AS (SELECT * FROM (VALUES ('Monday', 0), ('Tuesday', 1), ('Wednesday', 2), ('Thursday', 3), ('Friday', 4),
      ('Saturday', 5), ('Sunday', 6)) v(weekday, day_no))
SELECT d.weekday, d.day_no, round(g.t, 6) AS avg_title_words, round(g.a, 6) AS avg_article_words
FROM d LEFT JOIN g USING (weekday)""")
def word_counts_by_weekday(spark, sf):
    w = PR.word_counts_by_weekday(_news(spark, sf))
    return w.select("weekday", "day_no", r6("avg_title_words").alias("avg_title_words"),
                    r6("avg_article_words").alias("avg_article_words"))


@query("nearest_vector", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT v AS qv FROM e WHERE vec_id = 0),
s AS (SELECT vec_id, list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv))) AS sim
      FROM e, q WHERE vec_id <> 0)
SELECT CAST(0 AS BIGINT) AS query_id, vec_id AS match_id, round(sim, 6) AS sim FROM s ORDER BY sim DESC, vec_id LIMIT 1""")
def nearest_vector(spark, sf):
    nv = PR.nearest_vector(FX.table(spark, sf, "embeddings"), 0)
    return nv.select("query_id", "match_id", r6("sim").alias("sim"))


@query("nearest_vectors", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS match_id,
        round(list_dot_product(e.v, q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v))), 12) AS sim
      FROM e, e q WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, match_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, match_id, round(sim, 6) AS sim FROM r WHERE rank <= 5""")
def nearest_vectors(spark, sf):
    """The queries are the rows whose id is divisible by 20, against all rows."""
    vectors = FX.table(spark, sf, "embeddings")
    found = PR.nearest_vectors(vectors.filter(F.col("vec_id") % 20 == 0), vectors, 5)
    return found.select("query_id", "rank", "match_id", r6("sim").alias("sim"))


def _nday_returns(spark, sf):
    """n-day returns for n in N_DAYS plus the overnight return as n = 0 (the
    notebook's period list starts with 0 = overnight)."""
    grid = B.market_grid(FX.staged(FX.brand_bars(spark, sf), "brand_bars"))
    nd = B.n_day_returns(grid, N_DAYS).select("ticker", "n", "date", "ret")
    on = B.overnight_return(grid).select("ticker", F.lit(0).alias("n"), "date", "ret")
    return nd.unionByName(on)


def _nday_sql_all():
    parts = [f"SELECT ticker, {n} AS n, date, ret FROM (SELECT ticker, date, padded / NULLIF(lag(padded, {n}) "
             "OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM pd) WHERE ret IS NOT NULL" for n in N_DAYS]
    parts.append("SELECT ticker, 0 AS n, date, ret FROM (SELECT ticker, date, lead(open) OVER (PARTITION BY ticker "
                 "ORDER BY date) / NULLIF(adj_close, 0) - 1 AS ret FROM pd) WHERE ret IS NOT NULL")
    return S.with_(b=S.BRAND_BARS)[:-1] + ",\n" + _GRID_SQL + ",\nr AS (" + " UNION ALL ".join(parts) + ")"


@query("n_day_return_histogram", _nday_sql_all() + """,
mm AS (SELECT ticker, n, min(ret) AS mn, max(ret) AS mx FROM r GROUP BY ticker, n),
hb AS (SELECT r.ticker, r.n, CASE WHEN mx = mn THEN 0 ELSE
         least(CAST(floor((ret - mn) / ((mx - mn) / 50.0)) AS INTEGER), 49) END AS bin FROM r JOIN mm USING (ticker, n))
SELECT ticker, n, bin, count(*) AS cnt, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY ticker, n), 6) AS pct
FROM hb GROUP BY ticker, n, bin""")
def n_day_return_histogram(spark, sf):
    r = _nday_returns(spark, sf).withColumnRenamed("n", "_g_n")
    h = PR.equal_bins(r, "ret", 50, by=["ticker", "_g_n"])
    h = PR.group_percent(h.withColumnRenamed("n", "cnt").withColumnRenamed("_g_n", "n"),
                         ["ticker", "n"], n="cnt")
    return h.select("ticker", "n", "bin", "cnt", r6("pct").alias("pct"))


EXCLUDED = "Brand#25"


_TRIM_SQL = S.with_(b=S.BRAND_BARS)[:-1] + ",\n" + _GRID_SQL + f""",
o AS (SELECT ticker, date, lead(open) OVER (PARTITION BY ticker ORDER BY date) / NULLIF(adj_close, 0) - 1 AS ret FROM pd),
d1 AS (SELECT ticker, date, padded / NULLIF(lag(padded, 1) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM pd),
ab AS (SELECT ticker, date, 'Overnight' AS return_type, ret FROM o WHERE ret IS NOT NULL AND ticker <> '{EXCLUDED}'
       UNION ALL SELECT ticker, date, '1-day', ret FROM d1 WHERE ret IS NOT NULL AND ticker <> '{EXCLUDED}'),
ln AS (SELECT ticker, least(count(*) FILTER (WHERE return_type = 'Overnight'), count(*) FILTER (WHERE return_type = '1-day')) AS n
       FROM ab GROUP BY ticker),
u AS (SELECT ab.*, row_number() OVER (PARTITION BY ticker, return_type ORDER BY date) AS rk FROM ab)
"""


def _trimmed(spark, sf):
    grid = B.market_grid(FX.staged(FX.brand_bars(spark, sf), "brand_bars")).filter(F.col("ticker") != EXCLUDED)
    return B.return_pair_trim(B.overnight_return(grid), B.n_day_return(grid, 1))


@query("return_pair_trim", _TRIM_SQL + """
SELECT u.ticker, u.date, u.return_type, round(u.ret, 6) AS ret FROM u JOIN ln USING (ticker) WHERE rk <= n""")
def return_pair_trim(spark, sf):
    return _trimmed(spark, sf).select("ticker", "date", "return_type", r6("ret").alias("ret"))


@query("return_distribution", _TRIM_SQL + """
SELECT u.ticker, return_type, round(min(ret), 6) AS min, round(quantile_cont(ret, 0.25), 6) AS q1,
  round(quantile_cont(ret, 0.5), 6) AS median, round(quantile_cont(ret, 0.75), 6) AS q3, round(max(ret), 6) AS max
FROM u JOIN ln USING (ticker) WHERE rk <= n GROUP BY u.ticker, return_type""")
def return_distribution(spark, sf):
    b = PR.box_stats(_trimmed(spark, sf), "ret", ["ticker", "return_type"])
    return b.select("ticker", "return_type", *[r6(c).alias(c) for c in ("min", "q1", "median", "q3", "max")])


@query("bin_edge_compare", _nday_sql_all() + """,
ef AS (SELECT ticker, n, list_sort(list_distinct(quantile_cont(ret, [0.0, 1.0/3, 2.0/3, 1.0]))) AS e FROM r GROUP BY ticker, n),
ew AS (SELECT ticker, n, min(ret) AS mn, max(ret) AS mx FROM r GROUP BY ticker, n)
SELECT ticker, n, 'equal_frequency' AS kind, CAST(generate_subscripts(e, 1) - 1 AS INTEGER) AS i, round(unnest(e), 6) AS edge FROM ef
UNION ALL
SELECT ticker, n, 'equal_width' AS kind, i, round(CASE WHEN i = 3 THEN mx ELSE mn + i * ((mx - mn) / 3.0) END, 6) AS edge
FROM ew, (SELECT unnest(range(0, 4)) AS i)""")
def bin_edge_compare(spark, sf):
    r = _nday_returns(spark, sf)
    out = []
    for kind in ("equal_frequency", "equal_width"):
        if kind == "equal_frequency":
            e = TG.grouped_equal_frequency_edges(r, 3, ["ticker", "n"], value_col="ret")
        else:
            e = TG.grouped_equal_width_edges(r, 3, ["ticker", "n"], value_col="ret")
        out.append(e.select("ticker", "n", F.lit(kind).alias("kind"), F.posexplode("edges").alias("i", "edge")))
    u = out[0].unionByName(out[1])
    return u.select("ticker", "n", "kind", F.col("i").cast("int").alias("i"), r6("edge").alias("edge"))


def _date_strings_sql():
    return f"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '1995-' || lpad(CAST(doc_id % 40 AS VARCHAR), 2, '0') || '-30'
  WHEN doc_id % 5 = 0 THEN strftime(date, '%d-%m-%Y') ELSE strftime(date, '%Y-%m-%d') END AS s
  FROM (SELECT ord AS doc_id, date FROM ({S.DATED_NEWS}))"""


@query("date_parse_check", f"""
WITH d AS ({_date_strings_sql()})
SELECT doc_id, s, regexp_full_match(s, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AS format_ok,
  CAST(try_strptime(s, '%Y-%m-%d') AS DATE) AS parsed, strftime(CAST(try_strptime(s, '%Y-%m-%d') AS DATE), '%Y-%m-%d') AS formatted
FROM d""")
def date_parse_check(spark, sf):
    n = _news(spark, sf)
    s = (F.when(F.col("ord") % 7 == 0, F.concat(F.lit("1995-"), F.lpad((F.col("ord") % 40).cast("string"), 2, "0"),
                                                  F.lit("-30")))
         .when(F.col("ord") % 5 == 0, F.date_format("date", "dd-MM-yyyy"))
         .otherwise(F.date_format("date", "yyyy-MM-dd")))
    d = n.select(F.col("ord").alias("doc_id"), s.alias("s"))
    return Q.date_parse_check(d, "s")


@query("duration_text", """
WITH e AS (SELECT event_id, epoch_us(ts) - min(epoch_us(ts)) OVER () AS us FROM events),
s AS (SELECT event_id, us / 1000000.0 AS seconds, CAST(round_even(us / 1000000.0, 0) AS BIGINT) AS t FROM e)
SELECT event_id, round(seconds, 6) AS seconds,
  concat(CASE WHEN t // 86400 > 0 THEN CAST(t // 86400 AS VARCHAR) || 'd ' ELSE '' END,
         CASE WHEN (t % 86400) // 3600 > 0 THEN CAST((t % 86400) // 3600 AS VARCHAR) || 'h ' ELSE '' END,
         CASE WHEN (t % 3600) // 60 > 0 THEN CAST((t % 3600) // 60 AS VARCHAR) || 'm ' ELSE '' END,
         CAST(t % 60 AS VARCHAR), 's') AS text
FROM s""")
def duration_text(spark, sf):
    ev = FX.table(spark, sf, "events").select("event_id", "ts")
    first = ev.agg(F.min("ts").alias("_m"))
    from ..operators.util import one_row_join
    # elapsed time since the first event, independent of the session time zone
    e = one_row_join(ev, first).select(
        "event_id", (F.timestamp_diff("MICROSECOND", F.col("_m"), F.col("ts")) / F.lit(1e6)).alias("seconds"))
    return e.select("event_id", r6("seconds").alias("seconds"), dur("seconds").alias("text"))
