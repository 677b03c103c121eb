"""Line dedup by a log-template tree, in DataFrame functions only.

A line's path in the tree: its token count, then its leading part, then two more
parts.  Tokens with a digit are fields everywhere.  A line of `min_general` tokens
or more is cut into five equal parts; below its token count it goes on by the
first part, or, where that part is a field, by the second, or the third, and a
template keeps three parts in all and generalises the other two.  So one field
anywhere and two fields at any two places meet a template.  A shorter line has
a template for each part left out that leaves `min_tokens` other tokens; two
equal tokens are no evidence, so lines of three tokens have digit fields only.
Lines of fewer tokens have no template.

A template recurs when lines under it stand in at least `min_docs` distinct texts;
lines under a recurring template are dropped, in every document.  Copies of a
text count once.  Lines of `long_tokens` tokens or more are passages rather than
boilerplate: an equal one (digit fields masked) recurs from two texts on, and one
occurrence stays, so that no passage is lost: a long line goes where one of its
recurring templates stands in a text of a smaller md5.

The tree is grown from the top, by partial aggregation over distinct lines:

1. lines are counted whole, one row a line; a distinct line (its whole hash) has
   the number of its texts and the least of them.
2. a node of (token count, leading part) is opened only where two distinct lines
   of together `min_docs` texts meet in it; few lines of running text do.
3. for the lines of open nodes only, templates are counted the same way, and for
   those that may recur the distinct texts themselves.

Only hashes, positions and text keys are shuffled until the last join, which
takes each text to its positions; a template of many lines is a skew-split join.

NULL texts stay NULL; an empty text has no lines with a template.  Ids play no
part.  Repeated rows are copies of one text.  Columns beside the text are kept as
they are.  A very long text or line is treated as any other.  An empty table
gives none.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_table

FIELD = "<*>"
PARTS = 5
_PART = [f"p{k}" for k in range(PARTS)]


def _tokens(line: Column) -> Column:
    """A line's words, those with a digit masked; its white space is blanks only.
    A word is tried from its own start alone, so a very long one is read once."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, "(^| )[^ 0-9]*[0-9][^ ]*", f"$1{FIELD}")).otherwise(line)
    return F.array_remove(F.split(masked, " "), "")


def _text_key(text: Column) -> tuple[Column, Column]:
    """Two longs of the text's md5; the first orders texts."""
    digest = F.md5(text)
    return tuple(F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint") for at in (1, 16))


def _cuts(n: Column) -> list[Column]:
    return [F.floor(n * k / PARTS).cast("int") for k in range(PARTS + 1)]


def line_table(docs: DataFrame, min_tokens: int = 3, text_col: str = "text") -> DataFrame:
    """(t1, t2, pos, n, whole, p0..p4): a row per line that has a template: its
    text's key, its place, its tokens, the hash of all and of each part."""
    text = F.col(text_col).cast("string")
    t1, t2 = _text_key(text)
    blank = F.translate(text, "\t\x0b\x0c\r", "    ")
    t, n = F.col("tokens"), F.col("n")
    # cut into tokens before the lines become rows: the filter on their number then
    # stays above, where below it would cut every line a second time
    lines = (docs.filter(text.isNotNull())
             .select(t1.alias("t1"), t2.alias("t2"), F.posexplode(F.transform(F.split(blank, "\n"), _tokens)).alias("pos", "tokens"))
             .select("t1", "t2", "pos", "tokens", F.size("tokens").alias("n")).filter(n >= min_tokens))
    cut = _cuts(n)
    parts = [F.xxhash64(F.lit(k), F.slice(t, a + 1, b - a)).alias(_PART[k])
             for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]
    # the whole is hashed from its parts, which have fixed places
    return lines.select("t1", "t2", "pos", "n", *parts).withColumn("whole", F.xxhash64("n", *_PART))


def _key(kept: tuple[int, ...]) -> Column:
    return F.xxhash64(F.lit("".join(map(str, kept))), "n", *[_PART[k] for k in kept])


def _templates(min_tokens: int, min_general: int) -> Column:
    """The generalised templates of a distinct line, as an array."""
    n, cut = F.col("n"), _cuts(F.col("n"))
    of_three = F.array(*[_key(kept) for kept in combinations(range(PARTS), PARTS - 2)])
    one_out = F.array(*[F.when((cut[k] < cut[k + 1]) & (n - cut[k + 1] + cut[k] >= min_tokens),
                               _key(tuple(i for i in range(PARTS) if i != k))) for k in range(PARTS)])
    return F.when(n >= min_general, of_three).otherwise(F.filter(one_out, lambda x: x.isNotNull()))


def recurring_lines(docs: DataFrame, min_docs: int = 3, min_tokens: int = 3, min_general: int = 10,
                    long_tokens: int = 20, text_col: str = "text") -> DataFrame:
    """(t1, t2, drop): per distinct text the positions of the lines to drop."""
    lines = stage_table(line_table(docs, min_tokens, text_col), "op9-lines")
    distinct = stage_table(lines.groupBy("whole").agg(
        F.count_distinct("t1").alias("texts"), F.min("t1").alias("first"), F.first("n").alias("n"),
        *[F.first(p).alias(p) for p in _PART]), "op9-distinct")
    is_long = F.col("n") >= long_tokens

    def met(d: DataFrame, key: str) -> DataFrame:
        """Keys that lines of at least `min_docs` texts may share."""
        return (d.groupBy(key).agg(F.sum("texts").alias("texts"), F.count(F.lit(1)).alias("lines"))
                .filter((F.col("lines") > 1) & (F.col("texts") >= min_docs)).select(key))

    # nodes under the token count: of three parts that are kept one is among the first three
    nodes = (distinct.filter(F.col("n") >= min_general)
             .select("whole", "texts", F.explode(F.array(*[_key((k,)) for k in range(PARTS - 2)])).alias("node")))
    opened = nodes.join(met(nodes, "node"), "node").select("whole").distinct()
    general = distinct.filter(F.col("n") >= min_general).join(opened, "whole", "left_semi")
    short = distinct.filter(F.col("n") < min_general)
    under = (general.unionByName(short)
             .select("whole", "texts", F.explode(_templates(min_tokens, min_general)).alias("template")))
    under = stage_table(under.join(met(under, "template"), "template").select("whole", "template"), "op9-under")
    # the texts themselves, for the lines that are left
    held = lines.select("whole", "t1").join(under.select("whole").distinct(), "whole", "left_semi").distinct()
    often = (held.join(under, "whole").select("template", "t1").distinct().groupBy("template")
             .agg(F.count(F.lit(1)).alias("texts"), F.min("t1").alias("first"))
             .filter(F.col("texts") >= min_docs).select("template", "first"))
    by_field = under.join(often, "template").groupBy("whole").agg(F.min("first").alias("first"))
    alone = distinct.filter(F.col("texts") >= F.when(is_long, min(2, min_docs)).otherwise(min_docs)).select("whole", "first")
    # a long line stays in the text that is first under every template of it
    gone = by_field.unionByName(alone).groupBy("whole").agg(F.min("first").alias("first"))
    return (lines.select("t1", "t2", "pos", "n", "whole").join(gone, "whole").filter(~is_long | (F.col("t1") > F.col("first")))
            .groupBy("t1", "t2").agg(F.collect_set("pos").alias("drop")))     # at most a text's own lines


def drop_recurring_lines(docs: DataFrame, min_docs: int = 3, min_tokens: int = 3, min_general: int = 10,
                         long_tokens: int = 20, text_col: str = "text") -> DataFrame:
    """`docs` with the lines gone, plus n_lines and n_dropped (which replace
    columns of these names)."""
    drops = recurring_lines(docs, min_docs, min_tokens, min_general, long_tokens, text_col)
    rows = docs.drop(*[c for c in ("n_lines", "n_dropped") if c in docs.columns and c != text_col])
    t1, t2 = _text_key(F.col(text_col).cast("string"))
    packed = rows.select(F.struct(*[F.col(c) for c in rows.columns]).alias("_row"), t1.alias("_t1"), t2.alias("_t2"))
    j = packed.join(drops, (F.col("_t1") == F.col("t1")) & (F.col("_t2") == F.col("t2")), "left")
    text = F.col(f"_row.{text_col}").cast("string")
    j = j.withColumn("_lines", F.split(text, "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("drop"))
    text = F.when(F.col("drop").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.col("_lines")[i]), "\n"))
    return j.select(*[(text if c == text_col else F.col(f"_row.{c}")).alias(c) for c in rows.columns],
                    *[F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("bigint").alias(name)
                      for c, name in (("_lines", "n_lines"), ("drop", "n_dropped"))])
