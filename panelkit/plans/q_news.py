"""Catalog: news store, keyword counts, daily lists, incremental days, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import news as N
from ..session import stage_path
from ..sources import fixtures as FX
from ..sources import pages as PG
from ..sources import stores as ST
from ..sources.versions import DatedStore
from . import oracle_sql as S
from .catalog import query

NEWS_COLS = ("date", "url", "source", "title", "article")


def _news(spark, sf):
    return FX.dated_news(spark, sf)


def _kw(spark, sf):
    return N.keyword_count(_news(spark, sf), FX.FIXTURE_KEYWORDS)


@query("news_scan", S.with_(n=S.DATED_NEWS) + "SELECT date, url, source, title, article FROM n")
def news_scan(spark, sf):
    path = ST.unique_path(stage_path(spark, "news_csv"), "store")
    ST.news_csv_write(_news(spark, sf), path)
    return N.news_scan(spark, path, fmt="csv").select(*NEWS_COLS)


@query("news_snapshot_write", S.with_(n=S.DATED_NEWS) + "SELECT date, url, source, title, md5(article) AS article_md5, ord FROM n")
def news_snapshot_write(spark, sf):
    back = ST.news_snapshot_write(_news(spark, sf), ST.unique_path(stage_path(spark, "news_snapshots"), "store"))
    return back.select("date", "url", "source", "title", F.md5("article").alias("article_md5"), "ord")


@query("missing_dates", S.with_(n=S.DATED_NEWS) + """
SELECT d AS date FROM (SELECT CAST(unnest(generate_series(DATE '1994-12-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS d)
WHERE d NOT IN (SELECT date FROM n)""")
def missing_dates(spark, sf):
    return N.missing_dates(_news(spark, sf), "1994-12-01", "2001-12-31")


@query("append_new_days", S.with_(n=S.DATED_NEWS) + """,
st AS (SELECT date, url, source, title, md5(article) AS article_md5, ord FROM n WHERE date <= DATE '1998-06-30'),
nw AS (SELECT date, replace(url, 'doc://', 'new://') AS url, source, title, md5(article) AS article_md5, ord FROM n WHERE date >= DATE '1998-05-15')
SELECT * FROM st UNION ALL SELECT * FROM nw WHERE date NOT IN (SELECT date FROM st)""")
def append_new_days(spark, sf):
    """A store version of the first days, and one with the days it lacks."""
    n = _news(spark, sf).select("date", "url", "source", "title", "article", "ord")
    store = DatedStore(spark, ST.unique_path(stage_path(spark, "news_versions"), "store"))
    store.write(n.filter(F.col("date") <= F.lit("1998-06-30").cast("date")))
    new = n.filter(F.col("date") >= F.lit("1998-05-15").cast("date")) \
           .withColumn("url", F.replace("url", F.lit("doc://"), F.lit("new://")))
    return store.append(new).withColumn("article_md5", F.md5("article")).drop("article")


@query("resume_point", S.with_(n=S.DATED_NEWS) + """
SELECT coalesce(max(date) + 1, DATE '1995-01-01') AS resume_date FROM n""")
def resume_point(spark, sf):
    return N.resume_point(_news(spark, sf), "1995-01-01")


@query("drop_untitled", S.with_(n=S.DATED_NEWS) + "SELECT date, url, source, title FROM n WHERE title IS NOT NULL")
def drop_untitled(spark, sf):
    return N.drop_untitled(_news(spark, sf)).select("date", "url", "source", "title")


@query("news_slice", S.with_(n=S.DATED_NEWS) + f"""
SELECT date, url, source, title, ord, {S.kw_count()} AS keywords_count FROM n
WHERE date BETWEEN DATE '1998-02-01' AND DATE '1998-12-31'""")
def news_slice(spark, sf):
    return N.news_slice(_news(spark, sf), "1998-02-01", "1998-12-31", drop_articles=True,
                        keywords=FX.FIXTURE_KEYWORDS)


@query("keyword_count", S.with_(n=S.DATED_NEWS) + f"SELECT url, {S.kw_count()} AS keywords_count FROM n")
def keyword_count(spark, sf):
    return _kw(spark, sf).select("url", "keywords_count")


@query("relevant_flag", S.with_(n=S.DATED_NEWS) + f"SELECT url, {S.kw_count()} > 0 AS is_relevant FROM n")
def relevant_flag(spark, sf):
    return N.relevant_flag(_kw(spark, sf)).select("url", "is_relevant")


@query("daily_news_lists", S.with_(n=S.DATED_NEWS) + f"""
SELECT date, row_number() OVER (PARTITION BY date ORDER BY ord) - 1 AS pos, title,
  {S.kw_count()} AS keywords_count FROM n""")
def daily_news_lists(spark, sf):
    most = 10_000
    lists = N.daily_news_lists(_kw(spark, sf), ("title", "keywords_count"), most=most)
    z = lists.select("date", "part", F.posexplode(F.arrays_zip("title", "keywords_count")).alias("at", "z"))
    return z.select("date", (F.col("part") * F.lit(most) + F.col("at")).cast("bigint").alias("pos"), "z.title", "z.keywords_count")


@query("keyword_volume_by_year", S.with_(n=S.DATED_NEWS) + f"""
SELECT year(date) AS year, CAST(sum({S.kw_count()}) AS BIGINT) AS keyword_volume FROM n GROUP BY 1""")
def keyword_volume_by_year(spark, sf):
    return N.keyword_volume_by_year(_kw(spark, sf))


# A small ticker -> keywords dimension over the fixture keywords.
TICKER_KEYWORDS = {"TIO": ("tion",), "THE": ("the", "que"), "QUE": ("que",)}


def _any_kw_sql(kws):
    return " OR ".join(f"regexp_matches(coalesce(article, ''), '{k}')" for k in kws)


@query("relevant_articles_by_ticker", S.with_(n=S.DATED_NEWS) + " UNION ALL ".join(
    f"SELECT '{t}' AS ticker, count(*) FILTER (WHERE {_any_kw_sql(k)}) AS n_articles FROM n"
    for t, k in TICKER_KEYWORDS.items()))
def relevant_articles_by_ticker(spark, sf):
    return N.relevant_articles_by_ticker(_news(spark, sf), TICKER_KEYWORDS)


@query("articles_containing", S.with_(n=S.DATED_NEWS) + """
SELECT count(*) FILTER (WHERE contains(article, 'the')) AS n_articles FROM n""")
def articles_containing(spark, sf):
    return N.articles_containing(_news(spark, sf), "the")


@query("urls_per_day", S.with_(n=S.DATED_NEWS) + "SELECT date, count(url) AS n_urls FROM n GROUP BY date")
def urls_per_day(spark, sf):
    return N.urls_per_day(_news(spark, sf))


@query("published_time_local", """
SELECT event_id, ts AS time_utc,
  timezone('US/Eastern', timezone('UTC', ts)) AS time_et,
  CAST(ts AS DATE) AS date_utc, CAST(timezone('US/Eastern', timezone('UTC', ts)) AS DATE) AS date_et
FROM events""")
def published_time_local(spark, sf):
    ev = FX.table(spark, sf, "events").select("event_id", "ts")
    out = N.published_time_local(ev, "ts")
    return out.select("event_id", "time_utc", "time_et", "date_utc", "date_et")


@query("published_time_of_pages", S.published(S.classed_pages()))
def published_time_of_pages(spark, sf):
    """The time in each page's own meta tag, in the ISO forms that sites use."""
    timed = N.published_time_local(PG.page_published(FX.classed_pages(spark, sf)), "published")
    return timed.select("page_id", "published", "time_utc", "time_et", "date_utc", "date_et")


@query("page_extract", S.page_text("SELECT page_id, url, html FROM pages", "article"))
def page_extract(spark, sf):
    return PG.page_extract(FX.table(spark, sf, "pages"))


@query("page_extract_classed", S.page_text(S.classed_pages(), "div", "article-content"))
def page_extract_classed(spark, sf):
    return PG.page_extract(FX.classed_pages(spark, sf), "div", "article-content")


@query("page_links", S.page_links("SELECT page_id, url, html FROM pages"))
def page_links(spark, sf):
    return PG.page_links(FX.table(spark, sf, "pages"), "fixture")


@query("page_links_classed", S.page_links(S.classed_pages(), "post-link"))
def page_links_classed(spark, sf):
    return PG.page_links(FX.classed_pages(spark, sf), "fixture", "post-link")


@query("paragraph_split", """
SELECT doc_id, pos, replace(p, chr(10), ' ') AS paragraph FROM (
  SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS pos, unnest(ps) AS p
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents))
WHERE len(list_filter(regexp_split_to_array(p, '\\s+'), lambda w: w <> '')) > 10""")
def paragraph_split(spark, sf):
    from ..operators.text import paragraph_split as ps
    return ps(FX.table(spark, sf, "documents"), "doc_id", "text")


@query("append_new_days_stream", S.with_(n=S.DATED_NEWS) + """,
st AS (SELECT date, url, source, title, md5(article) AS article_md5, ord FROM n WHERE date <= DATE '1998-06-30'),
nw AS (SELECT date, replace(url, 'doc://', 'new://') AS url, source, title, md5(article) AS article_md5, ord FROM n WHERE date >= DATE '1998-05-15')
SELECT * FROM st UNION ALL SELECT * FROM nw WHERE date NOT IN (SELECT date FROM st)""")
def append_new_days_stream(spark, sf):
    """The store is seeded with the days up to June 30; new day files (from
    May 15, overlapping) arrive in an incoming folder and are streamed in."""
    from ..streaming.incremental import commit_days, ingest_new_days
    root = ST.unique_path(stage_path(spark, "news_stream"), "run")
    n = _news(spark, sf).select("date", "url", "source", "title", "article", "ord")
    n.filter(F.col("date") <= F.lit("1998-06-30").cast("date")) \
     .write.partitionBy("date").parquet(f"{root}/store")
    new = n.filter(F.col("date") >= F.lit("1998-05-15").cast("date")) \
           .withColumn("url", F.replace("url", F.lit("doc://"), F.lit("new://")))
    new.write.parquet(f"{root}/incoming")
    q = ingest_new_days(spark, f"{root}/incoming", new.schema, f"{root}/arrived", f"{root}/_checkpoint")
    q.awaitTermination()
    store = commit_days(spark, f"{root}/arrived", f"{root}/store", f"{root}/_base")
    return store.select("date", "url", "source", "title", F.md5("article").alias("article_md5"), "ord")



def _kw_sum_sql(kws):
    return " + ".join(f"len(regexp_extract_all(coalesce(article, ''), '{k}'))" for k in kws)


@query("keyword_volume_by_ticker_year", S.with_(n=S.DATED_NEWS) + " UNION ALL ".join(
    f"SELECT year(date) AS year, '{t}' AS ticker, CAST(sum({_kw_sum_sql(k)}) AS BIGINT) AS keyword_volume "
    "FROM n GROUP BY 1" for t, k in TICKER_KEYWORDS.items()))
def keyword_volume_by_ticker_year(spark, sf):
    return N.keyword_volume_by_ticker_year(_news(spark, sf), TICKER_KEYWORDS)
