import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelkit.llm import op3_suffix_dedup as op
from panelkit.llm.op3_suffix_dedup import multikey_order, remove_repeats, sliding_min

LENGTH = 100


def brute(rows, length):
    seen: dict[bytes, int] = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        for k in range(len(b) - length + 1):
            seen[b[k:k + length]] = seen.get(b[k:k + length], 0) + 1
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts():
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgé "), int(rng.integers(1, 8))))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(int(rng.integers(5, 60))) for _ in range(6)]
    rows = []
    for k in range(40):
        parts = [prose(int(rng.integers(0, 40)))]
        for _ in range(int(rng.integers(0, 3))):
            parts += [passages[int(rng.integers(0, 6))], prose(int(rng.integers(0, 30)))]
        rows.append((k, "".join(parts)))
    copy = list(rows[3][1] + prose(60))
    rows += [(50, "".join(copy)), (51, "".join(copy)), (51, "".join(copy)), (52, "".join(copy[:80]) + "#" + "".join(copy[80:]))]
    rows += [(60, None), (61, ""), (62, "x" * 99), (63, "ab" * 400), (64, "y" * 100), (65, "z" * 101), (None, "".join(copy[5:]))]
    return rows


def answers(spark, rows):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_bytes int")
    found = remove_repeats(docs, LENGTH).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=str)


@pytest.mark.parametrize("chunk", [1 << 20, 300])
def test_like_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(op, "CHUNK_BYTES", chunk)
    assert answers(spark, texts()) == brute(texts(), LENGTH)


def test_one_anchor_over_many_buckets(spark):
    # a passage just too short to be removed, and one that is, in all documents
    rng = np.random.default_rng(4)
    prose = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    short, long = prose(90), prose(130)
    rows = [(k, prose(150) + (short if k % 2 else long) + prose(150)) for k in range(120)]
    rows += [(200 + k, prose(60) + rows[k][1][100:330]) for k in range(10)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert answers(spark, rows) == brute(rows, LENGTH)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_empty_table(spark):
    assert answers(spark, []) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.integers(1, 12))
def test_sliding_min(values, width):
    if len(values) >= width:
        got = sliding_min(np.array(values, dtype=np.uint64), width)
        assert got.tolist() == [min(values[k:k + width]) for k in range(len(values) - width + 1)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 2)] * 3), max_size=40))
def test_multikey_order(rows):
    m = np.array(rows, dtype=np.uint64).reshape(-1, 3)
    assert [tuple(r) for r in m[multikey_order(m)].tolist()] == sorted(rows)


def test_one_suffix_after_many_texts_takes_many_buckets(spark, monkeypatch):
    # a block that ends hundreds of texts: few suffixes, and pieces that differ before them only
    monkeypatch.setattr(op, "BUCKET_BYTES", 4000)
    rng = np.random.default_rng(12)
    prose = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    block = prose(120)
    rows = [(k, prose(int(rng.integers(40, 160))) + block) for k in range(400)]
    rows += [(1000 + k, rows[k][1][7:] + prose(30)) for k in range(25)] + [(2000 + k, block[9:] + prose(80)) for k in range(40)]
    parts = []
    monkeypatch.setattr(op, "_bucket", lambda length, make=op._bucket: parts.append(length) or make(length))
    assert answers(spark, rows) == brute(rows, LENGTH)
    assert parts == [LENGTH]


def test_a_very_long_text(spark):
    rng = np.random.default_rng(13)
    long = "".join(rng.choice(list("abcdefghij "), 1_300_000))
    rows = [(1, long), (2, long[400_000:400_200]), (3, "x" * 90 + long[1_200_000:])]
    assert answers(spark, rows) == brute(rows, LENGTH)
