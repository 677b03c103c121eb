"""Exact removal of repeated byte strings by a range-partitioned suffix sort.

Every byte covered by a `length`-byte string that also starts anywhere else
(same document included) is removed; strings are judged on the input.

A suffix array over every byte would shuffle some `length` bytes per byte, so
suffixes are sampled by content.  Each window of `length` bytes has an anchor:
the start of its leftmost least-hashed KGRAM bytes.  Equal windows have equal
anchors at equal places, so only windows of one anchor string can be equal.
Consecutive windows with one anchor form a zone, about 170 bytes apart.

1. One pass over the texts writes a row per zone: its anchor's hash, the hash of
   its whole content, its place.  Zones whose anchor string is unique go.
2. Zones of equal content are one class, whatever the number of copies (partial
   aggregation).  A class sends its first zone to the sort, and its last too where
   it has several, so that copies meet in the order like any other repeat.
3. The zones sent are range-partitioned by sampled splitters on the suffix that
   starts at the anchor, and on what stands before it, so neither a frequent
   anchor nor a frequent suffix makes one bucket.  A bucket sorts its suffixes by
   multikey quicksort, eight bytes a key, and takes each one's longest common prefix
   with its neighbours; windows that would need more go.  The others are compared by
   content per anchor string.
4. Where an anchor string lies across a boundary of buckets, the windows that
   suffixes beyond the boundary can share are compared over all of its buckets in
   ranges of distances from the anchor: pieces that agree on all the bytes a range
   of windows covers repeat each of them; a piece that is alone with the bytes
   which all of them contain repeats none; what is neither is cut in four, from 64
   windows down to one.  A passage's end costs a piece a few rows a step, however
   many windows are repeated.
5. What a class's first zone has repeated, all its zones have.  The spans of a
   document are merged and cut out of its text.

Equality is of 64-bit content hashes within one 64-bit anchor hash.  A NULL text
is empty; texts shorter than `length` lose nothing.  Rows are told apart by id
and text: repeated rows are copies of each other.  NULL ids are kept.  Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .shingles import BYTE_VALUE, CHUNK_BYTES, mix, powers, prefix_hash, span_hash, text_chunks

KGRAM = 48
BUCKET_BYTES = 8 << 20      # zone bytes a bucket should hold
_PLACE = (1 << 24) - 1
_ZONE = ["k1", "k2", "start", "windows", "left", "kg", "zone"]
_ZONE_TYPE = "k1 bigint, k2 bigint, start bigint, windows int, left int, kg bigint, zone bigint"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i+width]) for every i, from block-wise running minima."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def zones(raw: np.ndarray, off: np.ndarray, length: int):
    """(document, first window, windows, bytes left of the anchor, anchor hash,
    content hash) of every zone of a chunk."""
    n = len(raw) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    step = np.zeros(len(raw) + 1, dtype=np.int32)
    whole = off[1:] - length + 1 > off[:-1]
    np.add.at(step, off[:-1][whole], 1)
    np.add.at(step, off[1:][whole] - length + 1, -1)
    valid = np.cumsum(step[:n]) > 0
    prefix = prefix_hash(BYTE_VALUE[raw])
    m = len(raw) - KGRAM + 1
    gram = mix((prefix[KGRAM:] - prefix[:m]) * powers(m, inverse=True))
    place = np.arange(m, dtype=np.uint64)
    anchor = sliding_min((gram & ~np.uint64(_PLACE)) | place, length - KGRAM + 1) & np.uint64(_PLACE)
    anchor = anchor.astype(np.int64)[:n]
    opens = valid.copy()
    opens[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    closes = valid.copy()
    closes[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    at = anchor[first]
    doc = np.searchsorted(off, first, side="right") - 1
    return (doc, first, last - first + 1, at - first, gram[at].view(np.int64),
            span_hash(prefix, first, last + length).view(np.int64))


def _zone_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            for row, raw, off in text_chunks(batch.column(2)):
                # a very long text goes in pieces that share length - 1 bytes
                for base in range(0, max(1, len(raw) - length + 1), CHUNK_BYTES) if len(off) == 2 else (0,):
                    piece = raw[base:base + CHUNK_BYTES + length - 1] if len(off) == 2 else raw
                    edges = np.array([0, len(piece)]) if len(off) == 2 else off
                    doc, first, count, left, kg, zone = zones(piece, edges, length)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k1[row + doc]), pa.array(k2[row + doc]), pa.array(first - edges[doc] + base),
                         pa.array(count, pa.int32()), pa.array(left, pa.int32()), pa.array(kg, pa.int64()),
                         pa.array(zone, pa.int64())], _ZONE)
    return run


def _zone_bytes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, asked = batch.column(2), batch.column(3).to_pylist()
            cols: list[list] = [[] for _ in _PIECE]
            for k, rows in enumerate(asked):
                data = texts[k].as_buffer()
                for r in rows:
                    body = data.slice(r["start"], r["windows"] - 1 + length).to_pybytes()
                    for c, x in zip(cols, (r["kg"], r["zone"], r["windows"], r["left"], r["tells"], body), strict=True):
                        c.append(x)
                if len(cols[0]) > 4000:
                    yield _piece_batch(cols)
                    cols = [[] for _ in _PIECE]
            yield _piece_batch(cols)
    return run


# A zone sent to the sort: its class (anchor, content, extent), whether what it
# has repeated counts for the class, and its bytes.
_CLASS = ["kg", "zone", "windows", "left"]
_PIECE = [*_CLASS, "tells", "body"]
_PIECE_TYPE = "kg bigint, zone bigint, windows int, left int, tells boolean, body binary"
_PIECE_ARROW = pa.schema([("kg", pa.int64()), ("zone", pa.int64()), ("windows", pa.int32()), ("left", pa.int32()),
                          ("tells", pa.bool_()), ("body", pa.binary())])


def _piece_batch(cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PIECE_ARROW, strict=True)], _PIECE)


def multikey_order(suffixes: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of big-endian words.  Every step sorts by
    one more word only what was equal so far; rows that stand alone are done."""
    order = np.arange(len(suffixes))
    lo, hi = np.array([0]), np.array([len(suffixes)])       # runs still equal
    for word in range(suffixes.shape[1]):
        keep = hi - lo > 1
        lo, hi = lo[keep], hi[keep]
        if not len(lo):
            break
        size = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
        run = np.repeat(np.arange(len(lo)), size)
        rows = order[at]
        key = suffixes[rows, word]
        by = np.lexsort((key, run))
        order[at] = rows[by]
        run, key = run[by], key[by]
        new = np.ones(len(run), dtype=bool)
        new[1:] = (run[1:] != run[:-1]) | (key[1:] != key[:-1])
        begin = np.flatnonzero(new)
        lo, hi = at[begin], at[np.append(begin[1:], len(at)) - 1] + 1
    return order


def repeated_windows(group: np.ndarray, left: np.ndarray, windows: np.ndarray, body: list[bytes],
                     length: int, reach: np.ndarray) -> np.ndarray:
    """rows x distances: whether the window that starts d bytes before the anchor
    equals one of another row of the same group.  `reach`: the longest prefix a row's suffix shares with another;
    windows that need more are not looked at."""
    width = length - KGRAM + 1
    wide = np.zeros((len(body), width - 1 + length), dtype=np.uint8)
    for k, b in enumerate(body):
        wide[k, width - 1 - left[k]:width - 1 - left[k] + len(b)] = np.frombuffer(b, dtype=np.uint8)
    prefix = np.zeros((len(body), wide.shape[1] + 1), dtype=np.uint64)
    np.cumsum(BYTE_VALUE[wide] * powers(wide.shape[1]), axis=1, out=prefix[:, 1:])
    out = np.zeros((len(body), width), dtype=bool)
    least = left - windows + 1
    for d in range(width):
        at = np.flatnonzero((least <= d) & (d <= left) & (reach >= length - d))
        if len(at) < 2:
            continue
        h = prefix[at, width - 1 - d + length] - prefix[at, width - 1 - d]
        order = np.lexsort((h, group[at]))
        same = (h[order][1:] == h[order][:-1]) & (group[at][order][1:] == group[at][order][:-1])
        twice = np.zeros(len(at), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        out[at[order[twice]], d] = True
    return out


def _runs(rep: np.ndarray, anchor: np.ndarray, length: int):
    """(row, from, to) of the byte spans that each row's repeated windows cover."""
    edge = np.zeros((rep.shape[0], rep.shape[1] + 2), dtype=np.int8)
    edge[:, 1:-1] = rep
    row, first = np.nonzero(np.diff(edge, axis=1) == 1)
    _, end = np.nonzero(np.diff(edge, axis=1) == -1)
    return row, anchor[row] - (end - 1), anchor[row] - first + length


_FOUND = [*_CLASS, "a", "b", "bucket", "tells", "body", "least"]
_FOUND_TYPE = ("kg bigint, zone bigint, windows int, left int, a int, b int, bucket int, tells boolean, body binary, least int")


def _bucket(length: int):
    """One bucket of suffixes: the spans found in it, from their zone's start, and
    the pieces of its first and last anchor string, which a neighbour may hold too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), _PIECE_ARROW)
        if not len(table):
            return
        bucket = TaskContext.get().partitionId()
        kg, _, windows, left = (table.column(i).to_numpy().astype(np.int64) for i in range(4))
        tells = table.column("tells").to_numpy()
        body = table.column("body").to_pylist()
        suffix = np.zeros((len(body), -(-length // 8) * 8), dtype=np.uint8)
        for k, b in enumerate(body):
            x = np.frombuffer(b, dtype=np.uint8)[left[k]:left[k] + length]
            suffix[k, :len(x)] = x
        order = multikey_order(suffix.view(">u8").astype(np.uint64))
        near = suffix[order]
        differ = near[1:] != near[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
        reach = np.zeros(len(order), dtype=np.int64)
        reach[order[1:]] = common
        reach[order[:-1]] = np.maximum(reach[order[:-1]], common)
        first, last = kg[order[0]], kg[order[-1]]

        def rows(at: np.ndarray, **more) -> pa.RecordBatch:
            got = table.take(pa.array(at)).combine_chunks()
            cols = {c: got.column(c).combine_chunks() if len(at) else pa.array([], _PIECE_ARROW.field(c).type) for c in _CLASS} | more
            return pa.RecordBatch.from_arrays([cols[c] for c in _FOUND], _FOUND)

        ask = np.flatnonzero(reach >= length - left)
        for part in _by_anchor(ask, kg):
            rep = repeated_windows(kg[part], left[part], windows[part], [body[i] for i in part], length, reach[part])
            rep[~tells[part]] = False
            row, a, b = _runs(rep, left[part], length)
            if len(row):
                none = len(row)
                yield rows(part[row], a=pa.array(a, pa.int32()), b=pa.array(b, pa.int32()), bucket=pa.nulls(none, pa.int32()),
                           tells=pa.nulls(none, pa.bool_()), body=pa.nulls(none, pa.binary()), least=pa.nulls(none, pa.int32()))
        # A suffix shares with one in another bucket at most what it shares with
        # its own bucket's first or last; those two may share more.
        every = np.arange(len(kg))
        beyond = np.zeros(len(kg), dtype=np.int64)
        for end in (order[0], order[-1]):
            differ = suffix != suffix[end]
            same = ~differ.any(axis=1)
            beyond = np.maximum(beyond, np.where((every == end) | same, length, differ.argmax(axis=1)))
        least = np.maximum(left - windows + 1, length - np.minimum(beyond, length))
        edge = np.flatnonzero(((kg == first) | (kg == last)) & (least <= left))
        for at in range(0, len(edge), 4096):
            k = edge[at:at + 4096]
            got = table.take(pa.array(k)).combine_chunks()
            yield rows(k, a=pa.nulls(len(k), pa.int32()), b=pa.nulls(len(k), pa.int32()), bucket=pa.array([bucket] * len(k), pa.int32()),
                       tells=got.column("tells").combine_chunks(), body=got.column("body").combine_chunks(),
                       least=pa.array(least[k], pa.int32()))
    return run


def _by_anchor(rows: np.ndarray, kg: np.ndarray, most: int = 4096) -> Iterator[np.ndarray]:
    """`rows` in runs of whole anchor strings, of about `most` rows each."""
    rows = rows[np.argsort(kg[rows], kind="stable")]
    begin = 0
    while begin < len(rows):
        end = min(begin + most, len(rows))
        while end < len(rows) and kg[rows[end]] == kg[rows[end - 1]]:
            end += 1
        yield rows[begin:end]
        begin = end


STEPS = (64, 16, 4, 1)      # windows of the ranges compared across boundaries


def _ranges(length: int, step: int):
    """(piece, anchor string, range, hash of the bytes all its windows contain, hash
    of those they cover) of every range of `step` distances asked for; the last is
    NULL where the piece has not got all windows of the range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kgs, lefts, leasts, asked = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5))
            out: list[list] = [[] for _ in range(5)]
            for k in range(batch.num_rows):
                body = np.frombuffer(batch.column(4)[k].as_buffer(), dtype=np.uint8)
                left = lefts[k]
                lo = np.concatenate([np.arange(max(a, leasts[k]) // step * step, min(b, left) + 1, step) for a, b in
                                     ((r["lo"], r["hi"]) for r in asked[k])] or [np.zeros(0, np.int64)]).astype(np.int64)
                hi = lo + step - 1
                lo, hi = lo[hi >= leasts[k]], hi[hi >= leasts[k]]
                if not len(lo):
                    continue
                prefix = prefix_hash(BYTE_VALUE[body])
                inner = span_hash(prefix, left - lo, left - hi + length)
                whole = (hi <= left) & (left - lo + length <= len(body))
                outer = span_hash(prefix, np.where(whole, left - hi, 0), np.where(whole, left - lo + length, 0))
                out[0] += [ids[k]] * len(lo)
                out[1] += [kgs[k]] * len(lo)
                out[2] += lo.tolist()
                out[3] += inner.view(np.int64).tolist()
                out[4] += [x if w else None for x, w in zip(outer.view(np.int64).tolist(), whole.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["id", "kg", "lo", "inner", "outer"])
    return run


def _across(split: DataFrame, length: int) -> DataFrame:
    """Spans, from their zone's start, that pieces of different buckets share.

    `split` has the pieces with an id of their own and the least distance to look at."""
    ask = split.select("id", F.array(F.struct(F.lit(0).alias("lo"), F.col("left").alias("hi"))).alias("asked"))
    found = None
    for step in STEPS:
        rows = stage_table(split.join(ask, "id").select("id", "kg", "left", "least", "body", "asked").mapInArrow(
            _ranges(length, step), "id bigint, kg bigint, lo bigint, inner bigint, outer bigint"), "op3-ranges")

        key = ["kg", "lo", "outer"]
        alike = (rows.filter("outer is not null").groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("one"))
                 .filter("n > 1").select(*key, "one"))
        marked = stage_table(rows.join(alike, key, "left").withColumn("covered", F.col("one").isNotNull()), "op3-covered")
        hits = marked.filter("covered").select("id", "lo", (F.col("lo") + step - 1).alias("hi"))
        found = hits if found is None else found.unionByName(hits)
        if step > 1:
            # of the pieces that are alike over the range one stands for all against those that are not
            left = marked.filter("not covered or id = one")
            met = (left.groupBy("kg", "lo", "inner").agg(F.count(F.lit(1)).alias("n"), F.min("covered").alias("all_covered"))
                   .filter("n > 1 and not all_covered").select("kg", "lo", "inner"))
            # at most a piece's own ranges
            ask = (left.join(met, ["kg", "lo", "inner"], "left_semi").groupBy("id")
                   .agg(F.collect_list(F.struct("lo", (F.col("lo") + step - 1).alias("hi"))).alias("asked")))
    return (found.join(split.filter("tells").select("id", *_CLASS), "id")
            .select(*_CLASS, (F.col("left") - F.col("hi")).cast("int").alias("a"),
                    (F.col("left") - F.col("lo") + length).cast("int").alias("b")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their spans."""
    for batch in batches:
        texts, spans = batch.column(1), batch.column(2).to_pylist()
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for k, found in enumerate(spans):
            data = texts[k].as_buffer().to_pybytes() if texts[k].is_valid else b""
            parts, at, removed, runs = [], 0, 0, 0
            for s in found or ():
                if s["b"] <= at:
                    continue
                if s["a"] > at or at == 0:
                    runs += 1
                a = max(s["a"], at)
                parts.append(data[at:a])
                removed += s["b"] - a
                at = s["b"]
            parts.append(data[at:])
            n_bytes.append(len(data))
            n_removed.append(removed)
            n_spans.append(runs)
            kept.append(b"".join(parts))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary()),
             pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())],
            ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def repeated_spans(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, a, b): byte spans [a, b) to remove, not merged; k1 is the id (the
    least long for NULL), k2 the text's hash."""
    if not 2 * KGRAM <= length < 1 << 16:
        raise ValueError(f"length must be at least {2 * KGRAM}")
    spark = docs.sparkSession
    texts = _keyed(docs, id_col, text_col)
    every = stage_table(texts.select("k1", "k2", "text").mapInArrow(_zone_rows(length), _ZONE_TYPE), "op3-zones")
    again = every.groupBy("kg").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("kg")
    held = stage_table(every.join(again, "kg", "left_semi"), "op3-repeated")
    place = F.struct("k1", "k2", "start")
    kinds = stage_table(held.groupBy(*_CLASS).agg(F.min(place).alias("first"), F.max(place).alias("last")), "op3-kinds")
    sent = kinds.select(F.explode(F.array_distinct(F.array(
        F.struct("first.*", F.lit(True).alias("tells")),
        F.struct("last.*", (F.col("first") == F.col("last")).alias("tells"))))).alias("at"), *_CLASS)
    pieces = (sent.select("at.k1", "at.k2", F.struct("at.start", *_CLASS, "at.tells").alias("ask"))
              .groupBy("k1", "k2").agg(F.collect_list("ask").alias("asks")))     # at most a text's own zones
    # of repeated rows each has the text, so they meet as copies
    body = (texts.join(pieces, ["k1", "k2"]).select("k1", "k2", "text", "asks")
            .mapInArrow(_zone_bytes(length), _PIECE_TYPE))
    body = stage_table(body, "op3-pieces")
    weight = body.agg(F.sum(F.length("body"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(weight / BUCKET_BYTES))
    # what stands before the anchor parts equal suffixes
    order = [F.expr("substring(body, left + 1)"), F.expr("substring(body, 1, left)")]
    found = stage_table(body.repartitionByRange(buckets, *order).mapInArrow(_bucket(length), _FOUND_TYPE), "op3-found")
    edge = found.filter("body is not null")
    across = (edge.groupBy("kg").agg(F.min("bucket").alias("x"), F.max("bucket").alias("y"))
              .filter("x < y").select("kg"))
    split = stage_table(edge.join(across, "kg", "left_semi").select(*_PIECE, "least")
                        .withColumn("id", F.monotonically_increasing_id()), "op3-split")
    told = found.filter("body is null").select(*_CLASS, "a", "b").unionByName(_across(split, length))
    return held.join(told.distinct(), _CLASS).select(
        "k1", "k2", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("id"),
                       F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("k1"),
                       F.xxhash64(text).alias("k2"), text.alias("text"))


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept, kept_sha256) for every row of
    `docs`; `kept` has the remaining bytes (which may cut a character)."""
    spans = repeated_spans(docs, length, id_col, text_col)
    by_text = spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))
    rows = _keyed(docs, id_col, text_col).join(by_text, ["k1", "k2"], "left").select("id", "text", "spans")
    return rows.mapInArrow(_cut, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"
                           ).withColumnRenamed("id", id_col)
