"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier per bit, over hashed byte
n-grams of the folded text, predicts that bit.  Decoding weighs each bit's loss
by how often that classifier was right on the language in training, takes the
nearest codeword and flags what lies close to a second one.

Fitting reads a bounded sample of labelled rows: at most about
`rows_per_language` of each language, picked by a hash of the id, so the tables
the driver holds are languages x 2**FEATURE_BITS counts whatever the input.
Prediction reads every whole text.

A NULL text, or one without a letter, is `und` with score 0.  Labels are learned
as they stand; rows with a NULL label or id are not learned from.  Without any
label everything is `und`.  Repeated rows give repeated rows; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import text_chunks

FEATURE_BITS = 16
SIZES = (2, 3)          # byte n-grams
EXHAUSTIVE_UP_TO = 6    # languages; beyond, random dense codes
AMBIGUOUS = 0.2         # least lead over the second codeword

# letters fold to lower case, every other ASCII byte to a space; bytes of longer
# characters stay
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each text, and the first one of each (one more).  A text
    is read with a space before and after it."""
    n = np.diff(off)
    first = off + np.arange(len(off)) * 2
    x = np.full(len(raw) + 2 * len(n) + max(SIZES), 32, dtype=np.uint32)
    x[np.arange(len(raw)) + np.repeat(np.arange(len(n)) * 2 + 1, n)] = _FOLD[raw]
    ids = []
    total = int(first[-1])
    for k, size in enumerate(SIZES):
        h = np.full(total, 0x9E37 + 77 * k, dtype=np.uint32)
        for i in range(size):
            h = (h ^ x[i:i + total]) * np.uint32(0x01000193)
        ids.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURE_BITS))
    # n-grams of one text lie together: text 0's of every size, then text 1's
    grams = np.stack(ids, axis=1).reshape(-1).astype(np.int32)
    return grams, first * len(SIZES)


def codewords(n: int) -> np.ndarray:
    """n x bits of +1 / -1.  Few languages: every split of them once.  More: the
    random code with the widest least distance out of a fixed number of tries."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE_UP_TO:
        # the first language is always +1; the other signs count up
        rows = [s for s in itertools.product((1, -1), repeat=n - 1) if -1 in s]
        return np.array([(1, *s) for s in rows], dtype=float).T
    rng = np.random.default_rng(7)
    bits = 10 * math.ceil(math.log2(n))
    best, widest = None, -1
    for _ in range(60):
        code = rng.choice((-1.0, 1.0), size=(n, bits))
        gap = min((int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)), default=0)
        if gap > widest and (np.abs(code.sum(axis=0)) < n).all():
            best, widest = code, gap
    return best if best is not None else np.where(np.eye(n) > 0, 1.0, -1.0)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray       # languages x bits
    weight: np.ndarray     # features x bits, log odds of bit +1
    trust: np.ndarray      # languages x bits, share of right bits in training

    def margins(self, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Mean log odds per n-gram, texts x bits."""
        out = np.zeros((len(first) - 1, self.code.shape[1]))
        some = np.flatnonzero(first[1:] > first[:-1])
        if len(some):
            out[some] = np.add.reduceat(self.weight[grams], first[some], axis=0, dtype=np.float64)
            out[some] /= (first[1:] - first[:-1])[some, None]
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword, its share against the others, and the lead."""
        z = 8.0 * margins[:, None, :] * self.code[None, :, :]
        loss = (np.logaddexp(0, -z) * self.trust[None]).sum(axis=2)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        top = np.sort(share, axis=1)
        lead = top[:, -1] - (top[:, -2] if top.shape[1] > 1 else 0)
        return best, share[np.arange(len(best)), best], lead


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for row, raw, off in text_chunks(batch.column(1)):
            grams, first = features(raw, off)
            for k in range(len(off) - 1):
                have = counts.setdefault(langs[row + k], np.zeros(1 << FEATURE_BITS, dtype=np.int64))
                have += np.bincount(grams[first[k]:first[k + 1]], minlength=len(have))
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), pa.array([c.tobytes() for c in counts.values()], pa.binary())],
        ["lang", "counts"])


def _add_counts(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), dtype=np.int64) for x in group.column("counts"))
    return pa.table({"lang": group.column("lang").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def _right_bits(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {x: k for k, x in enumerate(model.languages)}
        right, seen = np.zeros(model.code.shape, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        for batch in batches:
            langs = np.array([at[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            for row, raw, off in text_chunks(batch.column(1)):
                own = langs[row:row + len(off) - 1]
                sign = model.margins(*features(raw, off)) > 0
                np.add.at(right, own, sign == (model.code[own] > 0))
                np.add.at(seen, own, 1)
        lang, bit = (x.reshape(-1) for x in np.indices(right.shape))
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang), pa.array(bit), pa.array(right.reshape(-1)), pa.array(seen[lang])], ["lang", "bit", "hits", "seen"])
    return run


def fit(docs: DataFrame, learn: Column, rows_per_language: int = 5_000, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang", most_languages: int = 200) -> Model:
    """A model from the rows where `learn` holds; at most about
    `rows_per_language` of each language are read for it, and the `most_languages`
    languages of most rows (of equally many the first by name) are learned: each
    takes a count vector in every task, so stray labels must not add up."""
    known = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    size = {r[0]: r[1] for r in known.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(most_languages).collect()}
    if not size:
        return Model((), np.ones((0, 1)), np.zeros((1 << FEATURE_BITS, 1), np.float32), np.ones((0, 1)))
    share = F.lit(0.0)
    for lang, n in size.items():
        share = F.when(F.col(lang_col) == lang, min(1.0, rows_per_language / n)).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1_000_000)) / 1e6
    sample = known.filter(draw < share).select(F.col(lang_col).cast("string"), text_col)
    rows = (sample.mapInArrow(_gram_counts, "lang string, counts binary")
            .groupBy("lang").applyInArrow(_add_counts, "lang string, counts binary").collect())
    rows = sorted(rows, key=lambda r: r["lang"])
    languages = tuple(r["lang"] for r in rows)
    counts = np.array([np.frombuffer(r["counts"], dtype=np.int64) for r in rows], dtype=float)
    chance = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    weight = np.zeros((counts.shape[1], code.shape[1]), dtype=np.float32)
    for b in range(code.shape[1]):
        plus, minus = chance[code[:, b] > 0], chance[code[:, b] < 0]
        if len(plus) and len(minus):
            weight[:, b] = np.log(plus.mean(axis=0) / minus.mean(axis=0))
    model = Model(languages, code, weight, np.ones(code.shape))
    hits = (sample.mapInArrow(_right_bits(model), "lang long, bit long, hits long, seen long")
            .groupBy("lang", "bit").agg(F.sum("hits").alias("hits"), F.sum("seen").alias("seen")).collect())
    trust = np.ones(code.shape)
    for r in hits:
        trust[r["lang"], r["bit"]] = (r["hits"] + 1) / (r["seen"] + 2)
    return Model(languages, code, weight, trust / trust.sum(axis=1, keepdims=True))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for row, raw, off in text_chunks(batch.column(1)):
                m = len(off) - 1
                best, score, lead = np.full(m, len(names) - 1), np.zeros(m), np.zeros(m)
                use = letters[row:row + m]
                if len(model.languages):
                    b, s, gap = model.decode(model.margins(*features(raw, off)))
                    best, score, lead = np.where(use, b, best), np.where(use, s, 0.0), np.where(use, gap, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, m), batch.column(3).slice(row, m), pa.array(names[best], pa.string()),
                     pa.array(score), pa.array(lead < AMBIGUOUS)], ["id", "held_out", "lang_pred", "score", "ambiguous"])
    return run


def identify(docs: DataFrame, model: Model, held_out: Column | None = None, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(id_col, held_out, lang_pred, score, ambiguous) for every row of `docs`.
    Only the text decides the prediction."""
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"),
        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"),
        F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False)).alias("held_out"))
    return rows.mapInArrow(_predict(model), "id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean"
                           ).withColumnRenamed("id", id_col)
