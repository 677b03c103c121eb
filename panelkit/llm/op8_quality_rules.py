"""Quality rules: a threshold table compiled into one Spark projection.

`measures` adds the counts of every whole text; `verdict` compiles the rows of
`RULES` into one boolean expression over them.  Everything is a built-in column
expression: no user functions, no shuffle, one scan.

The measures are written as a few projections on top of each other, each of
which uses the arrays of the one below more than once; Spark then keeps those
arrays instead of computing them again.

A NULL text has no words, lines or symbols, like an empty one, and fails the
base rule.  NULL ids stay.  Repeated rows give repeated rows; extra columns are
kept by `measures` unless they carry one of its names, then they are replaced;
an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages the rules are written for.
STOP_WORDS = (
    "the of and to in is that it was for with on as at by be this are from or "
    "der die das und zu von mit den ein eine nicht auf für ist im dem des sich "
    "le la les de des et un une que est dans pour du en au qui sur il "
    "el los las y del con por se no su una para es al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """`part` / `whole` must lie in [least, most]; no whole at all passes."""
    name: str
    part: str
    whole: str
    least: float | None = None
    most: float | None = None

    def holds(self) -> Column:
        # compared as products, so that no division rounds
        part, whole = F.col(self.part).cast("double"), F.col(self.whole).cast("double")
        tests = []
        if self.least is not None:
            tests.append(part >= F.lit(self.least) * whole)
        if self.most is not None:
            tests.append(part <= F.lit(self.most) * whole)
        return reduce(lambda a, b: a & b, tests)


# Length, symbol, stop-word and line ratios.
RULES = (
    Rule("mean word length", "word_chars", "n_words", 2.0, 16.0),
    Rule("symbols per word", "n_symbols", "n_words", None, 0.125),
    Rule("marks per word", "n_marks", "n_words", None, 0.25),
    Rule("capital letters", "n_capitals", "word_chars", None, 0.5),
    Rule("stop words", "n_stop_words", "n_words", 0.02, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 0.5),
)

BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
_OWN = (*BASE_COLUMNS, "n_lines", "n_marks", "n_capitals", "n_stop_words", "kept",
        "_text", "_words", "_lines", "_grams", "_sorted")


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the counts the rules read."""
    clash = [c for c in docs.columns if c in _OWN and c != text_col]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    at = F.col("_words")
    d = docs.drop(*clash).withColumn("_text", text)
    d = d.withColumns({
        "_words": F.array_remove(F.split("_text", SPACE), ""),
        "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    n = F.size("_words")
    d = d.withColumn("_grams", F.when(
        n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
                            lambda i: F.xxhash64(at[i], at[i + 1], at[i + 2])))
        .otherwise(F.array().cast("array<bigint>")))
    # windows found twice or more stand next to each other when sorted; texts
    # whose windows all differ skip the sort
    d = d.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_grams")) < F.size("_grams"),
        F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    s = F.col("_sorted")
    twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
    covered = F.array_distinct(F.flatten(F.transform(
        twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))

    def without(chars: str) -> Column:
        return F.length("_text") - F.length(F.translate("_text", chars, ""))

    counts = {
        "n_words": n.cast("bigint"),
        "word_chars": F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("bigint"),
        "n_symbols": without(SYMBOLS).cast("bigint"),
        "n_marks": without("!?").cast("bigint"),
        "n_capitals": (F.length("_text") - F.length(F.regexp_replace("_text", r"\p{Lu}+", ""))).cast("bigint"),
        "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("bigint"),
        "n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": F.size(covered).cast("bigint"),
    }
    # one struct a row, opened again: filters on the counts stay above it, where
    # below they would hold a copy of every array the counts are made of
    rows = F.inline(F.array(F.struct(*[c.alias(name) for name, c in counts.items()])))
    return d.select(*[c for c in docs.columns if c not in clash], rows)


def verdict(measured: DataFrame, rules: tuple[Rule, ...] = RULES, least_words: int = 50,
            most_repeated: int = 50) -> DataFrame:
    """Adds base_failed and kept: one projection compiled from the table."""
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    holds = reduce(lambda a, b: a & b, [r.holds() for r in rules], F.lit(True))
    return measured.withColumns({"base_failed": base, "kept": ~base & holds})


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(id_col, the measures, base_failed, kept) for every row of `docs`."""
    wide = verdict(measures(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_raw")), "_raw"), rules)
    return wide.select(F.col("_id").alias(id_col), *BASE_COLUMNS[:5], "n_lines", "n_marks", "n_capitals",
                       "n_stop_words", "base_failed", "kept")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that pass, with their own columns."""
    columns = [F.col(f"_row.{c}").alias(c) for c in docs.columns]
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(text_col).alias("_raw"))
    return verdict(measures(packed, "_raw"), rules).filter("kept").select(*columns)
