"""Ranked lexical search: hybrid term-at-a-time and document-at-a-time.

Every item of a query table is ranked against all documents by

    sum of w * ((1000000000 * tf) div (1000 * tf + 12 * m))

over the item's terms, repeats included, with w = floor(1000 * ln((2 N + 2) /
(2 df + 1))), m = 75 + (25 n N) div L, all in 64-bit integers but the logarithm.
N documents have a term, they hold L terms, n of them in the document at hand.

1. One pass adds up N, L and the df of the items' terms (partial sums a task).
2. A second pass makes inverted lists of SHARD_BYTES of documents at a time, with
   each posting's impact (its share of the score) and the greatest of every
   BLOCK documents.  Each item is then searched in the shard:
   * term at a time: its short lists (at most a SHORT-th of the shard's documents
     each) are added up into one list of accumulators, which from then on
     is a single iterator with a bound of its own;
   * document at a time: blocks of documents are visited in order; where the
     accumulators' bound plus those of the long lists stays below the item's
     20th best score so far, the block is skipped.  In other blocks the lists are
     taken by falling bound, and only documents that can still reach that score
     are completed; nothing else is left out.
   The best scores go on from shard to shard, so a task's later shards skip more.
3. A task gives at most `top` rows an item; they are merged in two steps, by
   (item, bucket of ids) and by item.

The queries' terms go to the executors as a whole while the items hold at most
`index_bytes` of text, which is checked; a larger table is cut by a hash of the
item id into parts, each searched by its own passes, and an item beyond that
bound raises.  N, L and df are always of all documents, so results do not depend
on the parts.

Terms are runs of ASCII letters (A-Z lower-cased), digits and characters beyond
ASCII of the whole text, however long.  NULL, empty and termless texts count for
nothing and are never found; such items get no rows.  Equal scores go by
ascending id, NULL ids last.  Repeated documents are documents of their own.
Repeated (item, text) rows are one item; an item id with several texts is
ranked once for the terms of all its texts together.  Extra columns are ignored;
empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table
from .op10_decontamination import words
from .shingles import text_chunks

SHARD_BYTES = 8 << 20    # text whose lists are searched together
BLOCK = 128              # documents that are skipped or visited together
SHORT = 16               # a list of at most documents / SHORT is short
BUCKETS = 64             # of the first merge of the tasks' best
_OUT = "item bigint, id bigint, score bigint"


class Queries:
    """The items' terms: one sorted vocabulary, and per item its terms (places in
    the vocabulary) with how often it has them."""

    def __init__(self, items: list[tuple[int | None, list[str]]]):
        self.ids, held = [], []
        for i, texts in items:
            raw = np.frombuffer("\n".join(texts).encode(), dtype=np.uint8)
            h, _ = words(raw, np.array([0, len(raw)]))
            if len(h):
                self.ids.append(i)
                held.append(np.unique(h, return_counts=True))
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *[t for t, _ in held]]))
        self.terms = [(np.searchsorted(self.vocabulary, t), c) for t, c in held]

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Place of every word, -1 where no item has it."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)


def _counted(queries: Queries, raw: np.ndarray, off: np.ndarray):
    """(terms of each document, then per (document, place) the frequency)."""
    h, first = words(raw, off)
    place = queries.places(h)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    known = place >= 0
    size = max(1, len(queries.vocabulary))
    key, tf = np.unique(doc[known] * size + place[known], return_counts=True)
    return np.diff(first), key // size, key % size, tf


def _statistics(queries: Queries):
    """(place, documents): df of the vocabulary; N stands at -1 and L at -2."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = np.zeros(len(queries.vocabulary), dtype=np.int64), 0, 0
        for batch in batches:
            for _, raw, off in text_chunks(batch.column(0)):
                n, _, place, _ = _counted(queries, raw, off)
                df += np.bincount(place, minlength=len(df))
                docs += int((n > 0).sum())
                total += int(n.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((at, [-1, -2]))), pa.array(np.concatenate((df[at], [docs, total])))], ["place", "n"])
    return run


class Shard:
    """Inverted lists of some documents: documents ascending, impacts, and the
    greatest impact of each block."""

    def __init__(self, doc: np.ndarray, place: np.ndarray, impact: np.ndarray, size: int, terms: int):
        order = np.lexsort((doc, place))
        self.doc, self.impact, self.size = doc[order], impact[order], size
        self.at = np.searchsorted(place[order], np.arange(terms + 1))
        self.blocks = -(-size // BLOCK)
        self.edges = np.arange(self.blocks + 1) * BLOCK
        self._most: dict[int, np.ndarray] = {}

    def lists(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.at[term], self.at[term + 1]
        return self.doc[a:b], self.impact[a:b]

    def most(self, term: int) -> np.ndarray:
        got = self._most.get(term)
        if got is None:
            got = self._most[term] = block_most(*self.lists(term), self.blocks)
        return got


def block_most(doc: np.ndarray, value: np.ndarray, blocks: int) -> np.ndarray:
    out = np.zeros(blocks, dtype=np.int64)
    np.maximum.at(out, doc // BLOCK, value)
    return out


class Best:
    """The `top` best (score, id) of an item so far."""

    def __init__(self, top: int):
        self.top, self.score, self.rank_id, self.least = top, np.zeros(0, np.int64), [], 1

    def offer(self, score: np.ndarray, ids: list) -> None:
        score = np.concatenate((self.score, score))
        ids = self.rank_id + ids
        order = sorted(range(len(ids)), key=lambda k: (-score[k], ids[k] is None, ids[k] or 0))[:self.top]
        self.score, self.rank_id = score[order], [ids[k] for k in order]
        if len(order) == self.top:
            self.least = int(self.score[-1])


def search(shard: Shard, terms: np.ndarray, repeats: np.ndarray, best: Best, ids) -> int:
    """Offers `best` every document of the shard that can be among the best;
    returns how many blocks were visited."""
    size = shard.at[terms + 1] - shard.at[terms]
    held = size > 0
    terms, repeats, size = terms[held], repeats[held], size[held]
    if not len(terms):
        return 0
    short = size * SHORT <= shard.size
    # term at a time: the short lists become one list of accumulators
    parts = [(d, v * r) for t, r in zip(terms[short], repeats[short], strict=True) for d, v in (shard.lists(t),)]
    acc_doc, back = np.unique(np.concatenate([np.zeros(0, np.int64), *[d for d, _ in parts]]), return_inverse=True)
    acc = np.zeros(len(acc_doc), dtype=np.int64)
    np.add.at(acc, back, np.concatenate([np.zeros(0, np.int64), *[v for _, v in parts]]))
    iterators = [(acc_doc, acc, block_most(acc_doc, acc, shard.blocks))]
    for t, r in zip(terms[~short], repeats[~short], strict=True):
        d, v = shard.lists(t)
        iterators.append((d, v * r, shard.most(t) * r))
    # falling bounds; cuts[k] has where the blocks of iterator k begin
    iterators.sort(key=lambda x: -int(x[2].max()))
    cuts = [np.searchsorted(d, shard.edges) for d, _, _ in iterators]
    bound = np.array([m for _, _, m in iterators])
    rest = np.zeros((len(iterators) + 1, shard.blocks), dtype=np.int64)
    rest[:-1] = np.cumsum(bound[::-1], axis=0)[::-1]
    visited = 0
    for b in range(shard.blocks):
        if rest[0, b] < best.least:
            continue
        visited += 1
        score = np.zeros(BLOCK, dtype=np.int64)
        for k, ((d, v, _), cut) in enumerate(zip(iterators, cuts, strict=True)):
            x, y = cut[b], cut[b + 1]
            if k and rest[k, b] < best.least:
                # new documents cannot make it; only those that still can are completed
                alive = score + rest[k, b] >= best.least
                if not alive.any():
                    break
                there = d[x:y] - b * BLOCK
                keep = alive[there]
                score[there[keep]] += v[x:y][keep]
            else:
                score[d[x:y] - b * BLOCK] += v[x:y]
        else:
            found = np.flatnonzero(score >= best.least)
            if len(found):
                best.offer(score[found], [ids[b * BLOCK + k] for k in found.tolist()])
    return visited


def _ranked(queries: Queries, df: np.ndarray, docs: int, total: int, top: int):
    weight = np.floor(1000 * np.log((2 * docs + 2) / (2 * df + 1))).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in queries.ids]
        ids: list = []
        held: list[tuple] = []
        bytes_held = 0

        def flush():
            nonlocal ids, held, bytes_held
            if held:
                doc, place, impact = (np.concatenate(x) for x in zip(*held, strict=True))
                shard = Shard(doc, place, impact, len(ids), len(queries.vocabulary))
                for (terms, repeats), b in zip(queries.terms, best, strict=True):
                    search(shard, terms, repeats, b, ids)
            ids, held, bytes_held = [], [], 0

        for batch in batches:
            for row, raw, off in text_chunks(batch.column(1)):
                n, doc, place, tf = _counted(queries, raw, off)
                m = 75 + (25 * n[doc] * docs) // max(1, total)
                held.append((doc + len(ids), place, weight[place] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))))
                ids += batch.column(0).slice(row, len(n)).to_pylist()
                bytes_held += len(raw)
                if bytes_held >= SHARD_BYTES:
                    flush()
        flush()
        rows = [(i, d, int(s)) for i, b in zip(queries.ids, best, strict=True) for s, d in zip(b.score, b.rank_id, strict=True)]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item", "id", "score"])
    return run


def lexical_search(docs: DataFrame, items: DataFrame, top: int = 20, index_bytes: int = 16 << 20,
                   id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text") -> DataFrame:
    """(item_col, rank, id_col, score): each item's `top` best documents."""
    items = items.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    items = items.filter("text is not null").distinct()
    weight = items.groupBy("item").agg(F.sum(F.octet_length("text")).alias("w")).agg(F.sum("w"), F.max("w")).first()
    if (weight[1] or 0) > index_bytes:
        raise ValueError(f"an item has {weight[1]} bytes of text; index_bytes is {index_bytes}")
    parts = max(1, math.ceil((weight[0] or 0) / index_bytes))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for part in range(parts):
        # at most about index_bytes of text come to the driver here
        own = items.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
        queries = Queries([(r["item"], r["texts"]) for r in
                           own.groupBy("item").agg(F.sort_array(F.collect_list("text")).alias("texts")).orderBy("item").collect()])
        df, docs_n, total = np.zeros(len(queries.vocabulary), dtype=np.int64), 0, 0
        sums = texts.select("text").mapInArrow(_statistics(queries), "place bigint, n bigint")
        for r in sums.groupBy("place").agg(F.sum("n").alias("n")).collect():     # one row a term of the items
            if r["place"] == -1:
                docs_n = r["n"]
            elif r["place"] == -2:
                total = r["n"]
            else:
                df[r["place"]] = r["n"]
        hits = texts.mapInArrow(_ranked(queries, df, docs_n, total, top), _OUT)
        found = hits if found is None else found.unionByName(hits)
    found = stage_table(found, "op13-best")
    by = [F.desc("score"), F.asc_nulls_last("id")]
    first = (found.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)))
             .withColumn("rank", F.row_number().over(Window.partitionBy("item", "bucket").orderBy(*by))).filter(F.col("rank") <= top))
    return (first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).filter(F.col("rank") <= top)
            .select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"))
