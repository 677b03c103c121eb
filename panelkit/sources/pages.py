"""Article extraction from raw HTML pages, as a Spark job (no network).

A page is cut into tag and text tokens by one regular expression and read once,
in order, by an array fold that keeps the open elements as a stack: a start tag
is pushed, an end tag closes everything up to the nearest element of its name
(and is ignored where none is open), void and self-closing tags are never open.
So blocks, their direct children and unclosed elements are found at any nesting.

NULL and empty pages have no title, article or links.  Scripts, styles, comments
and declarations are no text.  Character references are decoded in text and
attributes.  Repeated pages give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import NOISE, TAG_NAME, TOKEN, VOID, attribute, decode_references, has_class, resolve_url

PUBLISHED = "article:published_time"
_STATE = ("struct<stack:array<string>,title_at:int,block_at:int,par_at:int,pars:int,title:array<string>,body:array<string>>")


def tokens(html: Column) -> Column:
    """The page's tags and texts in order."""
    return F.regexp_extract_all(F.regexp_replace(html, NOISE, ""), F.lit(TOKEN), F.lit(0))


def _read(token: Column, block: str, block_class: str | None) -> Column:
    """name (NULL for text), kind of tag, whether it is the block's, text."""
    is_tag = token.rlike("^</?[A-Za-z]")
    name = F.lower(F.regexp_extract(token, TAG_NAME, 1))
    wanted = (name == block) & (has_class(token, block_class) if block_class else F.lit(True))
    return F.struct(
        F.when(is_tag, name).alias("name"), token.startswith("</").alias("end"),
        (name.isin(*VOID) | token.endswith("/>")).alias("empty"), (is_tag & wanted).alias("block"),
        F.when(is_tag | token.rlike("^<[!?]"), "").otherwise(decode_references(token)).alias("text"))


def _fold(html: Column, block: str, block_class: str | None, paragraph: str, title: str) -> Column:
    """The state after the last token; *_at: how many elements enclose the open
    title, block or paragraph; -1 none yet, -2 it is closed."""
    read = F.transform(tokens(html), lambda t: _read(t, block, block_class))
    none = F.array().cast("array<string>")
    zero = F.struct(none.alias("stack"), F.lit(-1).alias("title_at"), F.lit(-1).alias("block_at"), F.lit(-1).alias("par_at"),
                    F.lit(0).alias("pars"), none.alias("title"), none.alias("body"))

    def state(a: Column, **new: Column) -> Column:
        return F.struct(*[new.get(c, a[c]).alias(c) for c in ("stack", "title_at", "block_at", "par_at", "pars", "title", "body")])

    def text(a: Column, t: Column) -> Column:
        return state(a, title=F.when(a["title_at"] >= 0, F.array_append(a["title"], t["text"])).otherwise(a["title"]),
                     body=F.when(a["par_at"] >= 0, F.array_append(a["body"], t["text"])).otherwise(a["body"]))

    def start(a: Column, t: Column) -> Column:
        depth = F.size(a["stack"])
        direct = (t["name"] == paragraph) & (a["block_at"] >= 0) & (depth == a["block_at"] + 1)
        opens = F.when(t["empty"], -2).otherwise(depth)
        first_title, first_block = (t["name"] == title) & (a["title_at"] == -1), t["block"] & (a["block_at"] == -1)
        return state(
            a, stack=F.when(t["empty"], a["stack"]).otherwise(F.array_prepend(a["stack"], t["name"])),
            title_at=F.when(first_title, opens).otherwise(a["title_at"]),
            block_at=F.when(first_block, opens).otherwise(a["block_at"]),
            par_at=F.when(direct & ~t["empty"], depth).otherwise(a["par_at"]),
            pars=a["pars"] + direct.cast("int"),
            body=F.when(direct & (a["pars"] > 0), F.array_append(a["body"], F.lit(" "))).otherwise(a["body"]))

    def end(a: Column, t: Column) -> Column:
        def closed(at: Column) -> Column:
            left = F.slice(a["stack"], at + 1, F.size(a["stack"]))
            depth = F.size(a["stack"]) - at
            return state(a, stack=left, **{c: F.when(a[c] >= depth, done).otherwise(a[c])
                                           for c, done in (("title_at", -2), ("block_at", -2), ("par_at", -1))})
        at = F.array_position(a["stack"], t["name"]).cast("int")
        # the place is bound once, by a one-element array
        return F.when(at == 0, a).otherwise(F.transform(F.array(at), closed)[0])

    return F.aggregate(read, zero.cast(_STATE), lambda a, t: F.when(t["name"].isNull(), text(a, t))
                       .when(t["end"], end(a, t)).otherwise(start(a, t)))


def page_extract(pages: DataFrame, block: str = "article", block_class: str | None = None, paragraph: str = "p",
                 title: str = "h1", html: str = "html") -> DataFrame:
    """(page_id, url, title, article): the text of the first `title` element, and
    the texts of the `paragraph` elements that are direct children of the first
    `block` element (of class `block_class`), joined by a space; NULL where there
    is no such element."""
    read = pages.select("page_id", "url", _fold(F.col(html).cast("string"), block, block_class, paragraph, title).alias("r"))
    return read.select("page_id", "url",
                       F.when(F.col("r.title_at") != -1, F.array_join("r.title", "")).alias("title"),
                       F.when(F.col("r.block_at") != -1, F.array_join("r.body", "")).alias("article"))


def page_links(pages: DataFrame, source: str, link_class: str | None = None, html: str = "html") -> DataFrame:
    """(page_id, pos, href, url, source): the links of an index page (those of class
    `link_class`) in order, as written and resolved against the page's URL.  Links
    without a target are left out."""
    tags = F.filter(tokens(F.col(html).cast("string")),
                    lambda t: t.rlike(r"(?i)^<a[\s/]") & (has_class(t, link_class) if link_class else F.lit(True)))
    hrefs = F.filter(F.transform(tags, lambda t: attribute(t, "href")), lambda h: h.isNotNull())
    return (pages.select("page_id", F.col("url").alias("base"), F.posexplode(hrefs).alias("pos", "href"))
            .select("page_id", "pos", "href", resolve_url(F.col("base"), F.col("href")).alias("url"), F.lit(source).alias("source")))


def page_published(pages: DataFrame, prop: str = PUBLISHED, html: str = "html") -> DataFrame:
    """(page_id, url, published): the content of the page's first meta tag of
    property `prop`; NULL without one."""
    metas = F.filter(tokens(F.col(html).cast("string")),
                     lambda t: t.rlike(r"(?i)^<meta[\s/]") & (attribute(t, "property") == prop))
    return pages.select("page_id", "url", attribute(F.get(metas, F.lit(0)), "content").alias("published"))
