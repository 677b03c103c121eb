"""Page extraction against a plain reading with the standard library's parser,
URL resolution against the cases of RFC 3986, publication times."""

import datetime as dt
import html
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from panelkit.functions.markup import VOID, decode_references, resolve_url
from panelkit.operators.news import iso_timestamp, published_time_local
from panelkit.sources.pages import page_extract, page_links, page_published


class Reader(HTMLParser):
    """A tree of [name, attributes, children] with the open elements as a stack."""

    def __init__(self):
        super().__init__()
        self.root = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1][2].append([tag, dict(attrs), []])

    def handle_endtag(self, tag):
        if any(n[0] == tag for n in self.open[1:]):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.open[-1][2].append(data)


def walk(node):
    for child in node[2]:
        if isinstance(child, list):
            yield child
            yield from walk(child)


def text(node):
    return "".join(c if isinstance(c, str) else "" if c[0] in ("script", "style") else text(c) for c in node[2])


def plain(page, block, block_class):
    reader = Reader()
    reader.feed(page)
    reader.close()
    nodes = list(walk(reader.root))
    title = next((text(n) for n in nodes if n[0] == "h1"), None)
    found = next((n for n in nodes if n[0] == block and (
        block_class is None or block_class in (n[1].get("class") or "").split())), None)
    return title, None if found is None else " ".join(text(c) for c in found[2] if isinstance(c, list) and c[0] == "p")


def random_page(rng):
    names = ["div", "p", "b", "article", "span", "h1", "li"]
    out = []
    for _ in range(rng.randint(0, 60)):
        kind = rng.random()
        name = rng.choice(names)
        if kind < 0.35:
            extra = rng.choice(["", ' class="body"', " class='x body y'", ' title="a > b" class="body"', ' class="bodyx"', ' id=k'])
            out.append(f"<{name.upper() if rng.random() < 0.2 else name}{extra}>")
        elif kind < 0.65:
            out.append(f"</{name}>")
        elif kind < 0.72:
            out.append(rng.choice(["<br>", "<br/>", "<img src='p>q'>", "<!-- <p> -->", "<script>var a='<p>';</script>", "<p/>", "<hr>"]))
        else:
            out.append(rng.choice(["one ", "two&amp;", "&lt;p&gt;", "&#8217;s", "&#x41;", " three\n", "&eacute;t", "&nosuch;", "a & b"]))
    return "".join(out)


def test_blocks_at_any_nesting_equal_a_tree(spark):
    rng = random.Random(5)
    pages = [random_page(rng) for _ in range(400)]
    pages += [
        '<div class="body"><article><p>inner</p></article><p>one<p>two</p></p><p>three</div><p>outside',
        '<article><h1>A <b>title</b></h1><p>x</article><article class="body"><p>y</p></article>',
        '<div title="1 > 0" class="lead body"><p>n&#176; 1<br>next</p><div><p>deep</p></div><p>last</p></div>']
    df = spark.createDataFrame([(k, f"http://h/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    for block, block_class in (("article", None), ("div", "body"), ("p", "body")):
        got = {r.page_id: (r.title, r.article) for r in page_extract(df, block, block_class).collect()}
        for k, p in enumerate(pages):
            assert got[k] == plain(p, block, block_class), p


def test_null_and_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "no tags at all"), (4, "u", "<h1>open <article><p>never closed"), (5, "u", "a < b > c"),
            (6, "u", '<a href="x'), (7, "u", "<p " + "x" * 200_000 + ">"), (8, "u", "<article><p>" + "w " * 300_000 + "</p></article>")]
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string").withColumn("title", F.lit(1))
    got = {r.page_id: (r.title, r.article) for r in page_extract(df).collect()}
    assert got[1] == got[2] == got[3] == got[5] == got[6] == got[7] == (None, None)
    assert got[4] == ("open never closed", "never closed") and len(got[8][1]) == 600_000
    assert page_extract(df).count() == 9 and page_extract(df.limit(0)).count() == 0
    assert page_links(df, "s").count() == 0


def test_references(spark):
    rows = ["&amp;lt;", "&#39;&#x27;&apos;", "&#8217;s &#X201c;", "&#128;&#150;&#0;&#xD800;&#x110000;&#99999999999999;", "&nosuch; & &", "AT&T",
            "&eacute;&Omega;&nbsp;.", "&#128512;", "&#65 x", "none", ""]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "s string").select(decode_references(F.col("s"))).collect()]
    assert got == [html.unescape(x) for x in rows]


# The examples of RFC 3986, 5.4.1 and 5.4.2.
RFC = {"g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g",
       "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s",
       "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s",
       "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/",
       "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g",
       "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g",
       "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/",
       "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y",
       "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x"}


def test_resolution_of_references(spark):
    df = spark.createDataFrame([("http://a/b/c/d;p?q", r) for r in RFC] + [("http://h", "x"), ("http://h?q", "x"), (None, "x/../y"), ("http://h", None),
                               ("http://h/a//b/", "..")], "base string, ref string")
    got = [r[0] for r in df.select(resolve_url(F.col("base"), F.col("ref"))).collect()]
    assert dict(zip(RFC, got)) == RFC
    assert got[len(RFC):] == ["http://h/x", "http://h/x", "y", None, "http://h/a//"]


def test_links_by_class(spark):
    page = ('<a class="post link" href="../n/1?a=1&amp;b=2">1</a><a href="/2">2</a><A CLASS=post HREF=3.html>3</A>'
            '<a title="x > y" class=\'post\' href=\'//o/4\'>4</a><a class="post">no target</a><a class="poster" href="5">5</a><abbr href="6">')
    df = spark.createDataFrame([(1, "http://h/p/q", page), (2, None, None)], "page_id long, url string, html string")
    got = [(r.pos, r.href, r.url, r.source) for r in page_links(df, "s", "post").orderBy("pos").collect()]
    assert got == [(0, "../n/1?a=1&b=2", "http://h/n/1?a=1&b=2", "s"), (1, "3.html", "http://h/p/3.html", "s"), (2, "//o/4", "http://o/4", "s")]
    assert page_links(df, "s").count() == 5


ISO = ["2023-03-12T07:30:00+00:00", "2023-03-12T07:30:00Z", "2023-03-12 07:30", "2023-03-12T07", "2023-03-12", "20230312T073000Z", "20230312",
       "2023-03-12T07:30:00.5", "2023-03-12T07:30:00.123456789-05:00", "2023-03-12T07:30:00,25+0530", "2023-12-31T23:59:59-01", "2024-02-29T00:00:00+23:59"]
NOT_ISO = ["", "yesterday", "2023-13-01", "2023-02-29", "2023-03-12T25:00", "2023-03-12T07:61", "2023-03-12T07:30:00+25:00", "2023-3-1", "12/03/2023", None,
           "2023-03-12T07:30:00+05:60", "2023-03-12T07:30:60"]


def test_iso_times(spark):
    df = spark.createDataFrame([(x,) for x in ISO + NOT_ISO], "s string")
    got = [r[0] for r in df.select(iso_timestamp("s")).collect()]
    for x, g in zip(ISO, got):
        want = dt.datetime.fromisoformat(x)
        assert g == (want.astimezone(dt.timezone.utc).replace(tzinfo=None) if want.tzinfo else want), x
    assert got[len(ISO):] == [None] * len(NOT_ISO)


def test_published_times_of_text_and_pages(spark):
    pages = spark.createDataFrame([
        (1, "u", '<meta charset="x"><meta property="article:published_time" content="2023-01-02T03:04:05+00:00"><meta property="article:published_time" content="2020-01-01">'),
        (2, "u", "<meta content='2023-07-02T03:04:05Z' property='article:published_time'/>"), (3, "u", "<p>none</p>"), (4, "u", None)],
        "page_id long, url string, html string")
    got = {r.page_id: (r.time_utc, r.time_et, r.date_utc, r.date_et) for r in published_time_local(page_published(pages), "published").collect()}
    assert got[1] == (dt.datetime(2023, 1, 2, 3, 4, 5), dt.datetime(2023, 1, 1, 22, 4, 5), dt.date(2023, 1, 2), dt.date(2023, 1, 1))
    assert got[2] == (dt.datetime(2023, 7, 2, 3, 4, 5), dt.datetime(2023, 7, 1, 23, 4, 5), dt.date(2023, 7, 2), dt.date(2023, 7, 1))
    assert got[3] == got[4] == (None,) * 4


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_published_times_of_timestamps(spark, kind):
    df = spark.sql(f"SELECT CAST('2023-03-12 06:59:59' AS {kind}) AS ts, 1 AS time_et")
    r = published_time_local(df, "ts").first()
    assert r.time_et == dt.datetime(2023, 3, 12, 1, 59, 59) and r.date_et == dt.date(2023, 3, 12)
