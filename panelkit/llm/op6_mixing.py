"""Mixing sources to target weights by a low-discrepancy slot schedule.

The mix is a sequence of slots of `block` words.  Slot n is the golden-ratio
point frac((n + 1) * phi) mapped through the cumulative target weights, so every
prefix of the mix holds each source in proportion.  A slot's rank among its
source's slots names a block of that source's stream: its documents shuffled by
a seeded hash, one after the other, again and again up to `most_repeats` times.
A document is taken for the words of its blocks, up to its source's target.  The
mix has as many slots as the targets have blocks, so the schedule decides how far
each stream is read: a source that the first slots serve too seldom ends short of
its target, by no more than the sequence's discrepancy (a few blocks).

Targets: source weights cycle over the sources in code point order, NULL last;
each source gets its share of `amount` times all words, but at most
`most_repeats` times its own; what that cuts off goes to the others by weight
until none is above.  That is the level L with target = min(cap, L * weight),
found by one sort of the sources by cap / weight.

Slots that the schedule gives a source beyond its target are passed over.  All
ranks and running sums are taken in two steps (per range, then within it), so no
source is sorted in one task; only the table of sources (one row each) is ordered
as a whole.  Everything is DataFrame functions.

NULL texts have size 0 and are taken for 0 words; NULL sources are one source;
NULL ids are kept.  `first_slot` is the first slot that takes a document, NULL where
none does.  An empty table gives no rows; other columns are ignored.  Repeated rows count each on their own (rows equal in id,
text and source are interchangeable).  Reruns agree whatever the partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table

PHI = (math.sqrt(5) - 1) / 2
RANGE_ROWS = 10_000     # rows of a source that one range should hold
RANGE_SLOTS = 8_192     # consecutive slots ranked together


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), amount: float = 1.5,
                   most_repeats: int = 2) -> DataFrame:
    """(source, source_size) -> also weight and target; one row per source."""
    # one row per source: the whole-table windows here order sources, not rows
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    d = sizes.select("source", "source_size", w.alias("weight"))
    d = d.withColumns({"cap": (F.lit(float(most_repeats)) * F.col("source_size")),
                       "wanted": F.lit(float(amount)) * F.sum("source_size").over(Window.partitionBy(F.lit(0)))})
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    d = d.withColumn("level", (F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("weight").over(after))
    # the first source whose cap holds at its level sets the level of the rest
    open_ = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(
        (F.col("cap") / F.col("weight")).alias("x"), F.col("level").alias("level")))).over(Window.partitionBy(F.lit(0)))
    level = F.coalesce(open_["level"], F.lit(float("inf")))
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("cap"), level * F.col("weight")))
    return d.select("source", "source_size", "weight", target.alias("target"))


def _running(d: DataFrame, keys: list[str], part: str, order: list, value: str, name: str) -> DataFrame:
    """Sum of `value` before each row within `keys`, in order of (part, order):
    over the parts' totals, then within a part."""
    total = d.groupBy(*keys, part).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(*keys, part, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_earlier"))
    on = [F.col(f"d.{k}").eqNullSafe(F.col(f"t.{k}")) for k in (*keys, part)]
    own = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return (d.alias("d").join(total.alias("t"), on, "left")
            .select("d.*", (F.col("t._earlier") + F.col("_own")).cast("bigint").alias(name)).drop("_own"))


def schedule(targets: DataFrame, block: int, step: float = PHI) -> DataFrame:
    """(slot, source, rank): which block of which source each slot holds.

    `targets` needs source and target; there are as many slots as the targets have
    whole blocks, and a source's ranks count its slots from 0."""
    spark = targets.sparkSession
    own = targets.select("source", F.floor("target").cast("bigint").alias("words")).filter("words > 0")
    # cumulative weights over the sources (one row each), in [0, 1)
    so_far = Window.orderBy(F.col("source").isNull(), "source")
    total = F.sum("words").over(Window.partitionBy(F.lit(0)))
    lines = own.select("source", ((F.sum("words").over(so_far) - F.col("words")) / total).alias("lo"),
                       (F.sum("words").over(so_far) / total).alias("hi"))
    n = math.ceil((own.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]) / block)
    slots = spark.range(n).select(F.col("id").alias("slot"))
    x = (F.col("slot") + 1).cast("double") * F.lit(step)
    # the unit interval is cut into cells, so that slots find their line by an
    # equality; a line is copied into the cells it reaches
    cells = 1024
    slots = slots.withColumn("point", x - F.floor(x)).withColumn("cell", F.floor(F.col("point") * cells).cast("int"))
    lines = lines.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("lo") * cells).cast("int"), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)).cast("int"))))
    drawn = (slots.join(lines, "cell").filter("point >= lo and point < hi").select("slot", "source")
             .withColumns({"range": F.floor(F.col("slot") / RANGE_SLOTS), "one": F.lit(1).cast("bigint")}))
    return _running(drawn, ["source"], "range", ["slot"], "one", "rank").select("slot", "source", "rank")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), amount: float = 1.5,
                most_repeats: int = 2, block: int = 32, seed: str = "mix", id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source", step: float = PHI) -> DataFrame:
    """(id_col, source, size, source_size, target, taken, first_slot) for every row
    of `docs`."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # a word starts where a character that is none is followed by one that is
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    size = F.size(F.array_remove(F.split(plain, " "), "")).cast("bigint")
    rows = stage_table(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("place")),
        "op6-sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = stage_table(
        source_targets(totals.select("source", "source_size"), weights, amount, most_repeats).alias("a")
        .join(totals.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
        .select("a.source", "a.source_size", "a.target", "b.n"), "op6-targets")
    # streams: where each document lies in one pass over its source
    r = rows.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    r = r.select("r.id", "r.source", "r.size", "r.place", "t.source_size", "t.target", "t.n")
    head = F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / float(1 << 32)
    r = r.withColumn("range", F.floor(head * F.ceil(F.col("n") / RANGE_ROWS)).cast("bigint"))
    lain = _running(r, ["source"], "range", ["place", "id", "size"], "size", "start")
    lain = stage_table(lain.withColumn("key", F.monotonically_increasing_id()).drop("range", "n", "place"), "op6-streams")
    # how far the slots read each stream
    slots = stage_table(schedule(targets.select("source", "target"), block, step), "op6-slots")
    read = slots.groupBy("source").agg(F.count(F.lit(1)).alias("slots"))
    read = (targets.alias("t").join(read.alias("r"), F.col("t.source").eqNullSafe(F.col("r.source")))
            .select("t.source", F.least(F.floor("t.target").cast("bigint"), F.col("r.slots") * block).alias("words")))
    # the words of each pass, piece by block
    piece = (lain.filter("size > 0").alias("x").join(read.alias("r"), F.col("x.source").eqNullSafe(F.col("r.source")))
             .select("x.key", "x.source", "x.size", "r.words",
                     F.explode(F.transform(F.sequence(F.lit(0), F.lit(most_repeats - 1)),
                                           lambda p: F.col("x.start") + p * F.col("x.source_size"))).alias("a"))
             .withColumn("b", F.least(F.col("a") + F.col("size"), F.col("words"))).filter("a < b")
             .select("key", "source", "a", "b", F.explode(F.sequence(
                 F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))).alias("rank"))
             .select("key", "source", "rank", (F.least(F.col("b"), (F.col("rank") + 1) * block)
                                               - F.greatest(F.col("a"), F.col("rank") * block)).alias("words")))
    taken = (piece.alias("p").join(slots.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))
                                   & (F.col("p.rank") == F.col("s.rank")))
             .groupBy("p.key").agg(F.sum("p.words").alias("taken"), F.min("s.slot").alias("first_slot")))
    return lain.join(taken, "key", "left").select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "first_slot")
