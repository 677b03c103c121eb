"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document's set is its distinct word shingles.  Two documents link when
100 * intersection >= percent * union.  `ngram_join` returns one row per
document with the size of its set and the smallest document id reachable by
links; `similar_pairs` returns the links a group's searches found.

How the work is dealt:

1. One pass over the texts gives every document the size and a 128-bit sum of
   its set (equal sets are one class from here on, so exact copies are joined
   by a hash group and never compared) and a fixed-size count sketch of all
   shingles (2**20 counters, whatever the input).  The sketch only orders
   shingles from rare to frequent; no result depends on it.
2. A second pass counts, for a quarter of all shingles picked by hash, how many
   classes have each.  Two sets of at least T common shingles share one of the
   n - T + 1 first of either under any fixed order; here the weighed quarter
   stands first, rarest first.  A class whose first n - T + 1 are its own alone
   ends there.  The classes of a list meet in the group of the list's first
   class, cut where sizes are too far apart.  Long lists are grouped by Spark's
   aggregations and joins (partial aggregation, skew split), the many short ones
   in packed blocks.  Groups are then cut by what their rare entries allow.
3. A group's texts go to one task while they hold at most `GROUP_SHINGLES`
   shingles; a larger group is cut into blocks that each get the group's first
   class, and what is not linked to it is searched against every block in
   further tasks.  In a task, T-occurrence search answers each query: the
   longest inverted lists are set apart, the short ones are merged (few entries
   on a heap with skips, many by counting all at once), candidates that can
   still reach T are probed for in the long lists by binary search, or counted
   there where that is less to read, and the exact overlap decides.  A class
   already joined to the group's first class is no query again: its links inside
   that component change nothing.  A group that is one component is left.
4. Links are contracted to components in Spark.

Nulls, empty texts and texts without words have the empty set: n_shingles 0 and
linked with nothing, copies included.  A NULL id is kept as a row of its own
(its component is NULL) and takes no part.  Repeated (id, text) rows give
repeated rows.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .components import connected_components
from .shingles import mix, shingle_sets, text_chunks

SKETCH_BITS = 20            # counters of the shingle sketch: order only, never results
SKETCH_SLICES = 64
BLOCK_ENTRIES = 300_000     # list entries a packed block should hold
GROUP_CLASSES = 4_000       # classes of a group up to which its members are weighed by rare entries
GROUP_SHINGLES = 1_000_000  # shingles of the sets that one search task holds
SKIP_WEIGHT = 0.0085        # DivideSkip's mu
HEAP_ENTRIES = 256          # entries of short lists up to which they are merged on a heap
PROBE_COST = 8              # a probe costs as much as so many entries counted
LONG_LEVEL = 6              # shingles of higher sketch levels are counted as long lists at once
LONG_FROM = 4_096           # lists from this length on are for Spark's own grouping


def needed(n, percent: int):
    """Least overlap of a set of size n with any partner."""
    return -(-percent * n // 100)


# ---- pass 1: classes and sketch -------------------------------------------------

def _profile(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            ids = batch.column(0)
            for row, raw, off in text_chunks(batch.column(1)):
                sets, first = shingle_sets(raw, off, width)
                sketch += np.bincount((sets >> np.uint64(64 - SKETCH_BITS)).astype(np.int64),
                                      minlength=len(sketch))
                n = np.diff(first)
                s1, s2 = set_sums(sets, first)
                weighed = np.concatenate(([0], np.cumsum(_weighed(sets))))
                m = len(n)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, m), pa.array(n, pa.int64()), pa.array(s1), pa.array(s2),
                     pa.array(weighed[first[1:]] - weighed[first[:-1]], pa.int64()),
                     pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                    ["id", "n", "s1", "s2", "weighed", "slice", "counts"])
        parts = [p.astype(np.uint32).tobytes() for p in np.split(sketch, SKETCH_SLICES)]
        none = pa.nulls(SKETCH_SLICES, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, none, none, pa.array(range(SKETCH_SLICES), pa.int32()), pa.array(parts, pa.binary())],
            ["id", "n", "s1", "s2", "weighed", "slice", "counts"])
    return run


def _weighed(sets: np.ndarray) -> np.ndarray:
    """The quarter of all shingles, by hash, whose frequency is counted."""
    return sets & np.uint64(3) == 0


def set_sums(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums per set: an order-free 128-bit name of its content."""
    with np.errstate(over="ignore"):
        one = np.concatenate((np.zeros(1, np.uint64), np.cumsum(sets)))
        other = sets * np.uint64(0xC2B2AE3D27D4EB4F)
        other ^= other >> np.uint64(29)
        other *= np.uint64(0x165667B19E3779F9)
        two = np.concatenate((np.zeros(1, np.uint64), np.cumsum(other)))
        return ((one[first[1:]] - one[first[:-1]]).view(np.int64),
                (two[first[1:]] - two[first[:-1]]).view(np.int64))


def _add_counts(group: pa.Table) -> pa.Table:
    """One slice of the sketch: log-scaled excess over the slice's mean."""
    total = np.zeros((1 << SKETCH_BITS) // SKETCH_SLICES, dtype=np.int64)
    for blob in group.column("counts"):
        total += np.frombuffer(blob.as_py(), dtype=np.uint32)
    mean = total.mean()
    floor = max(32.0, 6.0 * math.sqrt(mean))
    excess = np.maximum(total - mean, 0) / floor
    level = np.where(excess < 1, 0, np.minimum(15, 1 + np.log2(np.maximum(excess, 1)))).astype(np.uint8)
    return pa.table({"slice": group.column("slice").slice(0, 1), "level": pa.array([level.tobytes()], pa.binary())})


# ---- pass 2: inverted lists -------------------------------------------------------

WEIGHED, LONG, SPARE = 0, 1, 2   # kinds of entries, in a token's two low bits
LONG_DF, SPARE_DF = 60_000, 65_535


def _entries(width: int, percent: int, levels: np.ndarray, blocks: int):
    """Each class's weighed shingles, packed by block, once per chunk of texts;
    with fewer of them than n - T + 1, the least others make up for the rest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, raw, off in text_chunks(batch.column(0)):
                sets, first = shingle_sets(raw, off, width)
                n = np.diff(first)
                s1, s2 = set_sums(sets, first)
                order = np.lexsort((s2, s1, n))
                one = np.ones(len(n), dtype=bool)
                one[1:] = (np.diff(s1[order]) != 0) | (np.diff(s2[order]) != 0) | (np.diff(n[order]) != 0)
                use = np.zeros(len(n), dtype=bool)
                use[order[one]] = True
                doc = np.repeat(np.arange(len(n)), n)
                mine = _weighed(sets)
                long = mine & (levels[(sets >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] > LONG_LEVEL)
                entry = (sets & ~np.uint64(3)) | np.where(long, np.uint64(LONG), np.uint64(WEIGHED))
                pick = mine & use[doc]
                count = np.bincount(doc[mine], minlength=len(n))
                for k in np.flatnonzero(use & (n > 0) & (n - needed(n, percent) + 1 > count)):
                    at = first[k] + np.flatnonzero(~mine[first[k]:first[k + 1]])
                    at = at[:n[k] - needed(n[k], percent) + 1 - count[k]]     # a set ascends
                    entry[at] = (sets[at] & ~np.uint64(3)) | np.uint64(SPARE)
                    pick[at] = True
                held.append((entry[pick], s1[doc[pick]]))
                if sum(len(t) for t, _ in held) > 2 * BLOCK_ENTRIES:
                    yield from _pack(held, blocks)
                    held = []
        yield from _pack(held, blocks)
    return run


def _pack(held, blocks: int) -> Iterator[pa.RecordBatch]:
    tok = np.concatenate([np.zeros(0, np.uint64), *[t for t, _ in held]])
    cls = np.concatenate([np.zeros(0, np.int64), *[c for _, c in held]])
    if not len(tok):
        return
    # a long list is dealt by its entries: nothing is counted on it
    spread = np.where(tok & np.uint64(3) == LONG, mix(tok ^ cls.view(np.uint64)), tok)
    block = ((spread >> np.uint64(8)) % np.uint64(blocks)).astype(np.int32)
    order = np.argsort(block, kind="stable")
    tok, cls, block = tok[order].view(np.int64), cls[order], block[order]
    ids, start = np.unique(block, return_index=True)
    packed = [np.concatenate((tok[a:b], cls[a:b])).tobytes()
              for a, b in zip(start, np.append(start[1:], len(block)), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(packed, pa.binary())], ["block", "packed"])


def _shared(group: pa.Table) -> pa.Table:
    """The entries of a block that two classes or more have: (class, entry),
    where an entry is its frequency before its token, so the rarest come first."""
    parts = [np.frombuffer(x.as_py(), dtype=np.int64).reshape(2, -1) for x in group.column("packed")]
    tok, cls = np.concatenate(parts, axis=1)
    order = np.lexsort((cls, tok))
    tok, cls = tok[order].view(np.uint64), cls[order]
    new = np.ones(len(tok), dtype=bool)
    new[1:] = (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1])
    tok, cls = tok[new], cls[new]
    begin = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
    size = np.diff(np.append(begin, len(tok)))
    df, kind = np.repeat(size, size), tok & np.uint64(3)
    level = np.where(kind == LONG, LONG_DF, np.where(kind == SPARE, SPARE_DF, np.minimum(df, LONG_DF - 1)))
    keep = (df > 1) | (kind == LONG)
    entry = (level.astype(np.uint64) << np.uint64(48)) | (tok >> np.uint64(16))
    return pa.table({"cls": pa.array(cls[keep]), "entry": pa.array(entry[keep].view(np.int64))})


def _rarest(percent: int):
    """A class's shared entries among its n - T + 1 rarest.  Its weighed
    shingles that nothing shares come first of all; where they fill the n - T + 1
    places the class can link with nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, n, weighed = (batch.column(i).to_numpy() for i in range(3))
            out, rows = [], []
            for k, x in enumerate(batch.column(3)):
                entry = np.sort(x.values.to_numpy().view(np.uint64))
                spare = entry >= np.uint64(SPARE_DF << 48)
                shared = entry[~spare]
                places = int(n[k] - needed(n[k], percent) + 1 - (weighed[k] - len(shared)))
                if places > 0 and len(entry):
                    rare = np.concatenate((shared[:places], entry[spare])) if len(shared) < places else shared[:places]
                    if len(rare):
                        out.append(rare.tobytes())
                        rows.append(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls[rows]), pa.array(n[rows]), pa.array(out, pa.binary())], ["s1", "n", "rare"])
    return run


def _lists(percent: int, blocks: int):
    """Entries to their lists: short ones packed by block, long ones as rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rare = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in batch.column(2)]
            size = np.array([len(x) for x in rare])
            tok = np.concatenate(rare) if rare else np.zeros(0, np.uint64)
            cls, n = np.repeat(cls, size), np.repeat(n, size)
            long = tok >> np.uint64(48) >= LONG_FROM
            if m := int(long.sum()):
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()),
                     pa.array(tok[long].view(np.int64)), pa.array(cls[long]), pa.array(n[long])],
                    ["block", "packed", "token", "cls", "n"])
            tok, cls, n = tok[~long], cls[~long], n[~long]
            if not len(tok):
                continue
            block = ((tok >> np.uint64(8)) % np.uint64(blocks)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            tok, cls, n, block = tok[order].view(np.int64), cls[order], n[order], block[order]
            ids, start = np.unique(block, return_index=True)
            packed = [np.concatenate((tok[a:b], cls[a:b], n[a:b])).tobytes()
                      for a, b in zip(start, np.append(start[1:], len(block)), strict=True)]
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int32()), pa.array(packed, pa.binary()), none, none, none],
                ["block", "packed", "token", "cls", "n"])
    return run


def _meet(percent: int):
    """A block's lists, cut where sizes are too far apart to link: the classes
    of a piece with two or more, each with the piece's first class."""
    def run(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), dtype=np.int64).reshape(3, -1) for x in group.column("packed")]
        tok, cls, n = np.concatenate(parts, axis=1)
        order = np.lexsort((cls, n, tok))
        tok, cls, n = tok[order], cls[order], n[order]
        head = np.ones(len(tok), dtype=bool)
        head[1:] = (tok[1:] != tok[:-1]) | (100 * n[:-1] < percent * n[1:])
        begin = np.flatnonzero(head)
        size = np.diff(np.append(begin, len(tok)))
        many = np.repeat(size > 1, size)
        pair = np.stack((cls[many], np.repeat(cls[begin], size)[many]), axis=1)
        pair = np.unique(pair, axis=0)
        return pa.table({"cls": pa.array(pair[:, 0]), "pivot": pa.array(pair[:, 1])})
    return run


def _hopeful(percent: int):
    """A group cut into the parts that possible links connect, each named by its
    first class, so that parts found in several groups fall together.

    Of two sets, let x be the one whose last shared rare entry comes first: all
    that y shares of x's n - T + 1 rarest are rare entries of y too, and of x's
    others at most T - 1 can be shared.  So a link needs at least its overlap
    less that many common rare entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cls, n, rare in _rare_groups(batches):
            n = np.array(n, dtype=np.int64)
            size = n - needed(n, percent) + 1
            last = np.array([x[-1] for x in rare], dtype=np.uint64)
            cls = np.array(cls, dtype=np.int64)
            joined, index = _Joined(len(n)), ListIndex(rare)
            for i in range(len(n)):
                if joined.left == 1:
                    break
                if i and joined.label[i] == joined.label[0]:
                    continue          # what it links outside is found from there
                hits = index.counts(rare[i])
                overlap = -(-percent * (n[i] + n) // (100 + percent))
                rest = np.where(last[i] <= last, n[i] - size[i], n - size)
                fit = (hits >= np.maximum(1, overlap - rest)) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
                joined.join(i, np.flatnonzero(fit))
            root = joined.label
            least = np.full(len(n), np.iinfo(np.int64).max)
            np.minimum.at(least, root, cls)
            keep = np.bincount(root, minlength=len(n))[root] > 1
            yield pa.RecordBatch.from_arrays([pa.array(least[root][keep]), pa.array(cls[keep])], ["pivot", "cls"])
    return run


def _rare_groups(batches: Iterator[pa.RecordBatch]):
    key, cls, n, rare = None, [], [], []
    for batch in batches:
        for p, c, k, r in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if p != key:
                if cls:
                    yield key, cls, n, rare
                key, cls, n, rare = p, [], [], []
            cls.append(c)
            n.append(k)
            rare.append(np.frombuffer(r, dtype=np.uint64))
    if cls:
        yield key, cls, n, rare


# ---- search within a group --------------------------------------------------------

class ListIndex:
    """Inverted lists of the sets of one group."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        tok = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(tok, kind="stable")
        self.tok, self.doc = tok[order], doc[order]

    def places(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the query's lists lie in `doc`; empty ones left out."""
        lo = np.searchsorted(self.tok, query, side="left")
        hi = np.searchsorted(self.tok, query, side="right")
        return lo[hi > lo], hi[hi > lo]

    def counts(self, query: np.ndarray) -> np.ndarray:
        """How many of the query's lists hold each set."""
        return self._held(*self.places(query))

    def _held(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many of the lists at these places hold each set."""
        lists = [self.doc[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        return np.bincount(np.concatenate([self.doc[:0], *lists]), minlength=len(self.size))

    def search(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Indexes of the sets that link with `query`, ascending."""
        n = len(query)
        t = needed(n, percent)
        lo, hi = self.places(query)
        none = np.zeros(0, dtype=np.int64)
        if not n or len(lo) < t:
            return none
        order = np.argsort(hi - lo, kind="stable")
        lo, hi = lo[order], hi[order]
        longest = int(hi[-1] - lo[-1])
        apart = min(t - 1, int(t / (SKIP_WEIGHT * math.log2(longest) + 1)) if longest > 1 else t - 1)
        short = len(lo) - apart
        if int((hi[:short] - lo[:short]).sum()) <= HEAP_ENTRIES:
            lists = [self.doc[a:b].tolist() for a, b in zip(lo[:short].tolist(), hi[:short].tolist(), strict=True)]
            merged = list(merge_skip(lists, t - apart))
            doc, hits = np.array(merged, dtype=np.int64).reshape(-1, 2).T
        else:
            hits = self._held(lo[:short], hi[:short])
            doc = np.flatnonzero(hits >= t - apart)
            hits = hits[doc]
        m = self.size[doc]
        near = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        least = -(-percent * (n + m) // (100 + percent))
        alive = near & (hits + apart >= least)
        doc, hits, least = doc[alive], hits[alive], least[alive]
        if PROBE_COST * len(doc) * apart > int((hi[short:] - lo[short:]).sum()):
            hits = hits + self._held(lo[short:], hi[short:])[doc]
        else:
            for left, a, b in zip(range(apart, 0, -1), lo[short:].tolist(), hi[short:].tolist(), strict=True):
                alive = hits + left >= least
                if not alive.all():
                    doc, hits, least = doc[alive], hits[alive], least[alive]
                if not len(doc):
                    return none
                there = self.doc[a:b]
                hits = hits + (there[np.minimum(np.searchsorted(there, doc), b - a - 1)] == doc)
        return doc[100 * hits >= percent * (n + self.size[doc] - hits)]


def merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(document, number of lists holding it) where that is `least` or more;
    the lists ascend.  Lists that cannot lift a document to `least` are moved
    on to the heap's next head by binary search."""
    heap = [(s[0], k, 0) for k, s in enumerate(lists) if s]
    heapq.heapify(heap)
    while heap:
        doc = heap[0][0]
        popped = []
        while heap and heap[0][0] == doc:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            yield doc, len(popped)
            target = doc + 1
        else:
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                return
            target = heap[0][0]
        for _, k, i in popped:
            i = bisect_left(lists[k], target, i)
            if i < len(lists[k]):
                heapq.heappush(heap, (lists[k][i], k, i))


def _groups(width: int, batches: Iterator[pa.RecordBatch]):
    """Consecutive rows of one (pivot, cell): (pivot, ids, roles, sets)."""
    key, ids, roles, sets = None, [], [], []
    for batch in batches:
        pivot, cell, doc, role = (batch.column(i).to_pylist() for i in range(4))
        for row, raw, off in text_chunks(batch.column(4)):
            all_sets, first = shingle_sets(raw, off, width)
            for k in range(len(off) - 1):
                at = row + k
                if key != (pivot[at], cell[at]):
                    if ids:
                        yield key[0], ids, roles, sets
                    key, ids, roles, sets = (pivot[at], cell[at]), [], [], []
                ids.append(doc[at])
                roles.append(role[at])
                sets.append(all_sets[first[k]:first[k + 1]].copy())
    if ids:
        yield key[0], ids, roles, sets


class _Joined:
    """Components of a group: `label` names each member's, `left` is their number."""

    def __init__(self, n: int):
        self.label, self.left = np.arange(n), n
        self.held = [[k] for k in range(n)]

    def join(self, i: int, others: np.ndarray) -> list[int]:
        """Joins `others` to i; those that were in another component until then."""
        new = []
        for j in others[self.label[others] != self.label[i]].tolist():
            a, b = int(self.label[i]), int(self.label[j])
            if a != b:
                if len(self.held[a]) < len(self.held[b]):
                    a, b = b, a
                self.label[self.held[b]] = a
                self.held[a] += self.held[b]
                self.held[b] = []
                self.left -= 1
                new.append(j)
        return new


FIRST, MEMBER, QUERY, HUB = 0, 1, 2, 3
# roles: FIRST searches before all others; a MEMBER searches only in a small
# group, where it is not yet joined to FIRST; a QUERY searches until it is joined
# to the HUB members, those that FIRST was found to link with.  What it links
# outside is then found from there, where it is a member of the block searched.


def _search(width: int, percent: int, whole: bool):
    """Links within each group.  `whole`: the group is all here, so members not
    joined to the first class search too; else they come out as open (b NULL)
    for the further tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for pivot, ids, roles, sets in _groups(width, batches):
            order = sorted(range(len(ids)), key=lambda i: (roles[i] in (MEMBER, HUB), roles[i], ids[i]))
            ids, roles, sets = [ids[i] for i in order], [roles[i] for i in order], [sets[i] for i in order]
            index, joined = ListIndex(sets), _Joined(len(ids))
            hub = np.flatnonzero(np.array(roles) == HUB)
            joined.join(hub[0] if len(hub) else 0, hub)
            for i, role in enumerate(roles):
                if joined.left == 1:
                    break
                if role == MEMBER and (joined.label[i] == joined.label[0] or not whole):
                    if joined.label[i] != joined.label[0]:
                        out.append((pivot, ids[i], None))
                    continue
                if role == HUB or len(hub) and joined.label[i] == joined.label[hub[0]]:
                    continue
                for j in joined.join(i, index.search(sets[i], percent)):
                    out.append((pivot, min(ids[i], ids[j]), max(ids[i], ids[j])))
            if len(out) > 50_000:
                yield _links(out)
                out = []
        yield _links(out)
    return run


def _links(out) -> pa.RecordBatch:
    p, a, b = zip(*out, strict=True) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (p, a, b)], ["pivot", "a", "b"])


def ngram_join(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of `docs`; see the module
    text for how nulls, empty texts, ties and repeats are read."""
    profile, reps, links = _link_classes(docs, width, percent, id_col, text_col)
    comp = connected_components(links, "op2-components")
    by_class = reps.join(comp, reps.rep == comp.id, "left").select(
        "s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    p = profile.alias("p")
    c = by_class.alias("c")
    same = [F.col(f"p.{k}") == F.col(f"c.{k}") for k in ("s1", "s2", "n")]
    return p.join(c, same, "left").select(
        F.col("p.id").alias(id_col), F.col("p.n").alias("n_shingles"),
        F.when(F.col("p.id").isNotNull(), F.coalesce("c.component", "p.id")).alias("component_id"))


def similar_pairs(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(a, b), a < b: links between class representatives that span every
    component (a spanning set, not all pairs), with no pair twice."""
    return _link_classes(docs, width, percent, id_col, text_col)[2].distinct()


def _link_classes(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str):
    if not 50 < percent <= 100:
        raise ValueError("percent must lie above 50 and at most at 100")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    seen = stage_table(texts.mapInArrow(
        _profile(width), "id bigint, n bigint, s1 bigint, s2 bigint, weighed bigint, slice int, counts binary"), "op2-profile")
    profile = seen.filter("slice is null").select("id", "n", "s1", "s2", "weighed")
    # one small row per sketch slice, 2**20 bytes in all whatever the input
    rows = (seen.filter("slice is not null").select("slice", "counts").groupBy("slice")
            .applyInArrow(_add_counts, "slice int, level binary").collect())
    levels = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    step = len(levels) // SKETCH_SLICES
    for r in rows:
        levels[r["slice"] * step:(r["slice"] + 1) * step] = np.frombuffer(r["level"], dtype=np.uint8)
    reps = stage_table(profile.filter("n > 0 and id is not null").groupBy("s1", "s2", "n")
                       .agg(F.min("id").alias("rep"), F.min("weighed").alias("weighed")), "op2-classes")
    fewest = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # by the rows, as copies far apart in the table come once each
    total = profile.filter("id is not null").agg(F.sum("weighed")).first()[0] or 0
    blocks = max(fewest, math.ceil(total / BLOCK_ENTRIES))
    shared = (texts.filter("id is not null").select("text")
              .mapInArrow(_entries(width, percent, levels, blocks), "block int, packed binary")
              .groupBy("block").applyInArrow(_shared, "cls bigint, entry bigint"))
    of_class = shared.groupBy("cls").agg(F.collect_list("entry").alias("entries"))    # at most a text's own
    classes = stage_table(
        reps.join(of_class, reps.s1 == of_class.cls).select("s1", "n", "weighed", "entries")
        .mapInArrow(_rarest(percent), "s1 bigint, n bigint, rare binary"), "op2-rarest")
    total = classes.agg(F.sum(F.length("rare"))).first()[0] or 0
    blocks = max(fewest, math.ceil(total / 8 / BLOCK_ENTRIES))
    lists = stage_table(classes.select("s1", "n", "rare").mapInArrow(
        _lists(percent, blocks), "block int, packed binary, token bigint, cls bigint, n bigint"), "op2-lists")
    short = lists.filter("block is not null").groupBy("block").applyInArrow(_meet(percent), "cls bigint, pivot bigint")
    # long lists: a class meets its own band of sizes and the next; two that can
    # link lie in one band or in neighbours
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) * (1 - 1e-12)).cast("int")
    entry = lists.filter("block is null").select(
        "token", "cls", F.explode(F.array(band, band + 1)).alias("band")).distinct()
    heads = (entry.groupBy("token", "band").agg(F.min("cls").alias("pivot"), F.max("cls").alias("last"))
             .filter("pivot <> last").select("token", "band", "pivot"))
    met = stage_table(short.unionByName(entry.join(heads, ["token", "band"]).select("cls", "pivot")).distinct(), "op2-met")
    # the larger groups go on as they are, the others are first cut by their rare entries
    count = met.groupBy("pivot").agg((F.count(F.lit(1)) > GROUP_CLASSES).alias("large"))
    sized = met.join(count, "pivot").join(classes.withColumnRenamed("s1", "cls"), "cls")
    weighed = (sized.filter("not large").select("pivot", "cls", "n", "rare")
               .repartition("pivot").sortWithinPartitions("pivot")
               .mapInArrow(_hopeful(percent), "pivot bigint, cls bigint"))
    kept = weighed.unionByName(sized.filter("large").select("pivot", "cls")).distinct()
    members = stage_table(kept.join(reps.select(F.col("s1").alias("cls"), "n", "rep"), "cls")
                          .select("pivot", "rep", "n"), "op2-members")
    # how many tasks a group needs: by the shingles it holds
    size = (members.groupBy("pivot").agg(F.sum("n").alias("held"), F.min("rep").alias("head"))
            .select("pivot", "head", F.ceil(F.col("held") / GROUP_SHINGLES).cast("int").alias("parts")))
    laid = members.join(size, "pivot").withColumn("role", F.when(F.col("rep") == F.col("head"), FIRST).otherwise(MEMBER))
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    small = laid.filter("parts = 1").select("pivot", F.lit(0).alias("cell"), "rep", "role")
    cut = laid.filter("parts > 1")
    spread = (cut.filter(F.col("role") == MEMBER).select("pivot", part.alias("cell"), "rep", "role")
              .unionByName(cut.filter(F.col("role") == FIRST).select(
                  "pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("cell"), "rep", "role")))
    found = _search_cells(small, texts, width, percent, True)
    if not cut.isEmpty():
        first = stage_table(_search_cells(spread, texts, width, percent, False), "op2-first")
        queries = first.filter("b is null").select("pivot", F.col("a").alias("rep"))
        q = queries.join(members.select("pivot", "rep", "n"), ["pivot", "rep"])
        qsize = q.groupBy("pivot").agg(F.ceil(F.sum("n") / GROUP_SHINGLES).cast("int").alias("qparts"))
        grid = (F.col("qpart") * F.col("parts") + F.col("mpart")).cast("int").alias("cell")
        asked = (q.join(qsize, "pivot").join(size, "pivot")
                 .select("pivot", "rep", "parts", F.pmod(F.xxhash64("rep"), F.col("qparts")).cast("int").alias("qpart"))
                 .select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("mpart"))
                 .select("pivot", grid, "rep", F.lit(QUERY).alias("role")))
        open_ = queries.distinct().withColumn("role", F.lit(MEMBER))
        there = (cut.drop("role").join(qsize, "pivot").join(open_, ["pivot", "rep"], "left")
                 .select("pivot", "rep", "parts", F.coalesce("role", F.lit(HUB)).alias("role"), part.alias("mpart"),
                         F.explode(F.sequence(F.lit(0), F.col("qparts") - 1)).alias("qpart"))
                 .select("pivot", grid, "rep", "role"))
        # a class that is both a query and a member of a cell comes once, as a query
        cells = asked.unionByName(there).groupBy("pivot", "cell", "rep").agg(F.max("role").alias("role"))
        found = (found.unionByName(first.filter("b is not null"))
                 .unionByName(_search_cells(cells, texts, width, percent, False).filter("b is not null")))
    return profile, reps, stage_table(found.select("a", "b"), "op2-links")


def _search_cells(cells: DataFrame, texts: DataFrame, width: int, percent: int, whole: bool) -> DataFrame:
    # a document id that occurs in several rows: any one of its texts would do
    # for the join's shape, but each is searched, as each has its own set
    # the cells grow with the corpus, so they are not for broadcasting
    rows = cells.join(texts.hint("merge"), cells.rep == texts.id).select("pivot", "cell", "rep", "role", "text")
    return (rows.repartition("pivot", "cell").sortWithinPartitions("pivot", "cell")
            .mapInArrow(_search(width, percent, whole), "pivot bigint, a bigint, b bigint"))
