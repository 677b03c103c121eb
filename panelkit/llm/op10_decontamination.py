"""Benchmark decontamination: passages are queries on a BM25 index of test items.

The index holds the items: per term the items that contain it, with BM25 weights
divided by the item's own full score, so that an item's weights add up to 1 and
one threshold fits all.  A document's passages are windows of twice the longest
item's words, half overlapping, so an occurrence of an item lies whole in one of
them.  Every passage is a query of its distinct words; all items scoring at
least `least_score` are retrieved by block-max WAND, and each is verified: the
share of the word trigrams within its question, and of those ending in its
answer, that the passage has.  An item's answer is its last sentence, or its
last third if it has only one.

Most passages reach no item.  Before the search, a whole chunk's passages are
bounded at once: the weights of their less frequent words are added up per
item, and a passage whose sum plus all the item's frequent words stays below the
threshold for every item cannot reach it.  Nothing else is skipped.

The index goes to the executors as a whole while the items hold at most
`index_bytes` of text, which is checked; a larger benchmark is cut by a hash of
(item, text) into that many parts, each an index of its own, and the documents
are read once per part.  Number of items, document frequencies, mean length and
the longest item are those of all items, counted once in Spark, so scores and
passages, and with them the result, do not depend on the parts.

Words are runs of ASCII letters (lower-cased), digits and bytes of other
characters.  NULL and empty texts have no passages; NULL or empty items match
nothing.  NULL ids are kept as they stand.  Repeated documents give repeated
rows; repeated (item, text) rows are one item, further texts of an item id items
of their own.  A very long document is searched passage by passage, a very long
item makes passages longer.  Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .shingles import BYTE_VALUE, ngram_hashes, prefix_hash, span_hash, text_chunks

K1, B = 1.2, 0.75
BLOCK = 16               # postings of a block
FREQUENT = 0.02          # a term in a larger share of the items is frequent
GRAM = 3                 # words of the runs that are compared

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the first word of each text (one more)."""
    if not len(raw):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(off), dtype=np.int64)
    inside = _WORD[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[off] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return span_hash(prefix_hash(BYTE_VALUE[_FOLD[raw]]), start, end), np.searchsorted(start, off)


def _hash_words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return words(raw, np.array([0, len(raw)]))[0]


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the `width`-word runs, in order."""
    if len(hashes) < width:
        return np.zeros(0, dtype=np.uint64)
    return ngram_hashes(hashes, np.array([0, len(hashes)]), width)[0]


def question_and_answer(text: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Width, then the item's runs of words within the question, and those that
    end in the answer.  Items of fewer than three words are one run."""
    parts = [h for p in re.split(r"(?<=[.!?])\s+", text.strip()) if len(h := _hash_words(p))]
    h = _hash_words(text)
    answer = len(parts[-1]) if len(parts) > 1 else len(h) // 3
    width = min(GRAM, len(h))
    g = grams(h, width)
    cut = max(0, min(len(g), len(h) - answer - width + 1))
    return width, np.unique(g[:cut]), np.unique(g[cut:])


class ItemStatistics:
    """What a score needs of all items: their number, mean length, the longest, and
    how many hold each of some terms (ascending)."""

    def __init__(self, items: int, words_: int, span: int, terms: np.ndarray, df: np.ndarray):
        self.items, self.mean, self.span, self.terms, self._df = items, words_ / max(1, items), max(1, span), terms, df

    @classmethod
    def of(cls, texts: list[str]) -> ItemStatistics:
        hashed = [h for t in texts if len(h := _hash_words(t))]
        terms, df = np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.unique(h) for h in hashed]]), return_counts=True)
        return cls(len(hashed), sum(map(len, hashed)), max(map(len, hashed), default=1), terms, df)

    def df(self, terms: np.ndarray) -> np.ndarray:
        return self._df[np.searchsorted(self.terms, terms)]


class ItemIndex:
    """Inverted lists of normalised BM25 weights, in blocks with their maxima."""

    def __init__(self, items: list[tuple[int, str]], least_score: float, about: ItemStatistics | None = None):
        about = about or ItemStatistics.of([t for _, t in items])
        hashed = [(i, t, _hash_words(t)) for i, t in items]
        hashed = [x for x in hashed if len(x[2])]
        self.ids = [i for i, _, _ in hashed]
        self.parts = [question_and_answer(t) for _, t, _ in hashed]
        self.span = about.span
        tf = [np.unique(h, return_counts=True) for _, _, h in hashed]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *[t for t, _ in tf]]))
        df = about.df(self.vocabulary)
        idf = np.log(1 + (about.items - df + 0.5) / (df + 0.5))
        term, item, weight = [], [], []
        for k, (t, c) in enumerate(tf):
            at = np.searchsorted(self.vocabulary, t)
            w = idf[at] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(hashed[k][2]) / about.mean))
            term.append(at)
            item.append(np.full(len(t), k))
            weight.append(w / w.sum())
        term, item, weight = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (term, item, weight))
        order = np.lexsort((item, term))
        self.item, self.weight = item[order], weight[order].astype(float)
        self.at = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))
        self.least = least_score
        # words so frequent that they cannot carry an item over the threshold
        self.frequent = df > max(2, FREQUENT * about.items)
        common = np.repeat(self.frequent, np.diff(self.at))
        self.slack = np.bincount(self.item[common], self.weight[common], minlength=len(self.ids))

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Term of every word, -1 where no item has it."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def postings(self, term: int) -> tuple[list[int], list[float]]:
        a, b = self.at[term], self.at[term + 1]
        return self.item[a:b].tolist(), self.weight[a:b].tolist()

    def promising(self, window: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Windows some item of which may reach the threshold; (window, term)
        pairs may repeat."""
        every = np.unique(window)
        open_ = every if (self.slack >= self.least - 1e-9).any() else every[:0]
        rare = ~self.frequent[term]
        pair = np.unique(window[rare] * len(self.vocabulary) + term[rare])
        w, t = pair // len(self.vocabulary), pair % len(self.vocabulary)
        size = self.at[t + 1] - self.at[t]
        post = np.repeat(self.at[t] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
        key = np.repeat(w, size) * len(self.ids) + self.item[post]
        key, place = np.unique(key, return_inverse=True)
        total = np.bincount(place, self.weight[post], minlength=len(key))
        reach = total + self.slack[key % len(self.ids)] >= self.least - 1e-9
        return np.union1d(open_, key[reach] // len(self.ids))

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items scoring at least the threshold: block-max WAND."""
        return block_max_wand([self.postings(t) for t in terms], self.least - 1e-9)


class _Cursor:
    def __init__(self, items: list[int], weights: list[float]):
        self.items, self.weights, self.at = items, weights, 0
        self.most = max(weights)
        self.block_most = [max(weights[k:k + BLOCK]) for k in range(0, len(items), BLOCK)]

    @property
    def item(self) -> int:
        return self.items[self.at]

    def seek(self, item: int) -> bool:
        self.at = bisect_left(self.items, item, self.at)
        return self.at < len(self.items)

    def block_of(self, item: int) -> tuple[float, int]:
        """Greatest weight and last item of the block that would hold `item`."""
        k = bisect_left(self.items, item, self.at) // BLOCK
        if k >= len(self.block_most):
            return 0.0, 1 << 62
        return self.block_most[k], self.items[min((k + 1) * BLOCK, len(self.items)) - 1]


def block_max_wand(lists: list[tuple[list[int], list[float]]], least: float) -> list[tuple[int, float]]:
    cursors = [_Cursor(i, w) for i, w in lists if i]
    found = []
    while cursors:
        cursors.sort(key=lambda c: c.item)
        bound, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            bound += c.most
            if bound >= least:
                pivot = k
                break
        if pivot < 0:
            return found
        item = cursors[pivot].item
        while pivot + 1 < len(cursors) and cursors[pivot + 1].item == item:
            pivot += 1
        blocks = [c.block_of(item) for c in cursors[:pivot + 1]]
        if sum(w for w, _ in blocks) < least:
            # nothing up to the nearest block end, or the next list's item, reaches it
            nxt = min(last for _, last in blocks) + 1
            if pivot + 1 < len(cursors):
                nxt = min(nxt, cursors[pivot + 1].item)
            nxt = max(nxt, item + 1)
            cursors = [c for k, c in enumerate(cursors) if k > pivot or c.seek(nxt)]
        elif cursors[0].item == item:
            score = sum(c.weights[c.at] for c in cursors[:pivot + 1])
            if score >= least:
                found.append((item, score))
            cursors = [c for k, c in enumerate(cursors) if k > pivot or c.seek(item + 1)]
        else:
            cursors = [c for k, c in enumerate(cursors) if k >= pivot or c.item >= item or c.seek(item)]
    return found


def _search(index: ItemIndex, least_overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = index.span
        for batch in batches:
            ids = batch.column(0)
            for row, raw, off in text_chunks(batch.column(1)):
                out = []
                hashes, first = words(raw, off)
                count = np.diff(first)
                term = index.terms(hashes)
                doc = np.repeat(np.arange(len(count)), count)
                known = np.flatnonzero(term >= 0)
                windows = np.where(count > 0, np.maximum(1, -(-count // half) - 1), 0)
                base = np.concatenate(([0], np.cumsum(windows)))
                slot = (known - first[doc[known]]) // half
                later, sooner = slot < windows[doc[known]], slot > 0
                window = np.concatenate((base[doc[known]][later] + slot[later], base[doc[known]][sooner] + slot[sooner] - 1))
                terms = np.concatenate((term[known][later], term[known][sooner]))
                best: dict[tuple[int, int], tuple] = {}
                for w in index.promising(window, terms).tolist() if len(window) else ():
                    d = int(np.searchsorted(base, w, side="right")) - 1
                    a = first[d] + (w - base[d]) * half
                    b = min(a + 2 * half, first[d + 1])
                    t = np.unique(term[a:b])
                    for item, score in index.retrieve(t[t >= 0].tolist()):
                        width, *parts = index.parts[item]
                        here = grams(hashes[a:b], width)
                        q, ans = (float(np.isin(p, here).mean()) if len(p) else 1.0 for p in parts)
                        if q >= least_overlap and ans >= least_overlap:
                            got = (score, q, ans)
                            best[d, item] = max(best.get((d, item), got), got)
                for (d, item), (score, q, ans) in best.items():
                    out.append((ids[row + d].as_py(), index.ids[item], min(1.0, score), q, ans))
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                                 ["id", "item", "score", "question", "answer"])
    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, term, words): a row per distinct term of an item, and one without a
    term that has the item's words."""
    for batch in batches:
        for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = _hash_words(text)
            terms = np.unique(h).view(np.int64).tolist()
            if terms:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * (len(terms) + 1), pa.int32()), pa.array([*terms, None], pa.int64()),
                     pa.array([None] * len(terms) + [len(h)], pa.int64())], ["part", "term", "words"])


def find_leaks(docs: DataFrame, items: DataFrame, least_score: float = 0.6, least_overlap: float = 0.5,
               index_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, item_col, score, question_overlap, answer_overlap) of every
    verified pair, with its best passage's figures."""
    items = items.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    items = items.filter("item is not null and text is not null").distinct()
    weight = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(weight / index_bytes))
    items = stage_table(items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)).cast("int")), "op10-items")
    terms = stage_table(items.select("part", "text").mapInArrow(_item_terms, "part int, term bigint, words bigint"), "op10-terms")
    n, words_, span = terms.filter("term is null").agg(F.count(F.lit(1)), F.sum("words"), F.max("words")).first()
    held = terms.filter("term is not null")
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for part in range(parts):
        # at most about index_bytes of text come to the driver here, and its terms
        rows = items.filter(F.col("part") == part).orderBy("item", "text").collect()
        own = df.join(held.filter(F.col("part") == part).select("term").distinct(), "term").collect()
        order = sorted((np.int64(r["term"]).view(np.uint64), r["df"]) for r in own)
        about = ItemStatistics(n, words_ or 0, span or 1, np.array([t for t, _ in order], dtype=np.uint64),
                               np.array([d for _, d in order], dtype=np.int64))
        index = ItemIndex([(r["item"], r["text"]) for r in rows], least_score, about)
        hits = texts.mapInArrow(_search(index, least_overlap),
                                "id bigint, item bigint, score double, question double, answer double")
        found = hits if found is None else found.unionByName(hits)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "score",
                        F.col("question").alias("question_overlap"), F.col("answer").alias("answer_overlap"))


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` whose id is in no verified pair."""
    leaks = find_leaks(docs, items, id_col=id_col, **options).select(F.col(id_col).alias("_leak")).distinct()
    return docs.join(leaks, docs[id_col] == leaks["_leak"], "left_anti")
