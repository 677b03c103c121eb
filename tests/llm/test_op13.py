"""Ranked lexical search against a plain ranking in Python, and its own SQL."""

import math
import re

import numpy as np
import pytest

from panelkit.llm import op13_lexical_search as op
from panelkit.llm.op13_lexical_search import Best, Shard, lexical_search, search

FOLD = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def plain(docs, items, top=20):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n_docs, total = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    texts = {}
    for i, t in items:
        if t is not None:
            texts.setdefault(i, set()).add(t)
    out = {}
    for i, own in texts.items():
        query = [x for t in own for x in terms(t)]
        found = []
        for d, t in held:
            m = 75 + (25 * len(t) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                        * ((1_000_000_000 * t.count(x)) // (1000 * t.count(x) + 12 * m)) for x in query if x in df and x in t)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out[i] = [(k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(found, key=lambda f: f[:3])[:top])]
    return {i: r for i, r in out.items() if r}


def corpus(seed, n_docs=400, n_items=25):
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(1, 800)
    share /= share.sum()
    vocabulary = [f"w{k}" if k % 5 else f"W{k}é" for k in range(799)]

    def text(n):
        return " ".join(vocabulary[k] for k in rng.choice(799, n, p=share))

    docs = [(k, text(int(rng.integers(0, 120)))) for k in range(n_docs)]
    docs += [(n_docs + k, docs[k][1]) for k in range(40)]                 # copies: ties
    docs += [(9000, None), (9001, ""), (9002, " .,; "), (None, text(30)), (None, None), (3, text(20))]
    items = [(k, text(int(rng.integers(1, 40)))) for k in range(n_items)]
    items += [items[0], (100, None), (101, "?!"), (102, "unheard of"), (0, text(5)), (None, text(6)), (103, "W0É w0é w1 w1 w1")]
    return docs, items


def got(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    out = {}
    for r in lexical_search(d, i, **options).orderBy("item_id", "rank").collect():
        out.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    return out


@pytest.mark.parametrize("shard,block,short,index", [(8 << 20, 128, 16, 16 << 20), (4000, 16, 4, 400), (2000, 8, 1000, 1 << 20)])
def test_equals_a_plain_ranking(spark, monkeypatch, shard, block, short, index):
    monkeypatch.setattr(op, "SHARD_BYTES", shard)
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "SHORT", short)
    docs, items = corpus(4)
    assert got(spark, docs, items, index_bytes=index) == plain(docs, items)


def test_blocks_are_skipped_and_nothing_is_lost():
    rng = np.random.default_rng(1)
    n, terms_n = 4000, 6
    parts = []
    for t, share in enumerate((0.9, 0.7, 0.4, 0.02, 0.01, 0.003)):
        d = np.flatnonzero(rng.random(n) < share)
        impact = rng.integers(1, 100, len(d)) * (1 + 60 * (t > 2))
        if t <= 2:
            impact = np.where(d < 300, impact * 10, impact)
        parts.append((d, np.full(len(d), t), impact))
    doc, place, impact = (np.concatenate(x) for x in zip(*parts))
    shard = Shard(doc, place, impact, n, terms_n)
    total = np.bincount(doc, impact, minlength=n).astype(np.int64)
    best = Best(20)
    visited = search(shard, np.arange(terms_n), np.ones(terms_n, dtype=np.int64), best, list(range(n)))
    expect = sorted(range(n), key=lambda d: (-total[d], d))[:20]
    assert best.rank_id == expect and best.score.tolist() == total[expect].tolist()
    assert visited < shard.blocks


def test_empty_tables_long_texts_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search(docs, items).count() == 0
    some = spark.createDataFrame([(1, "a b", 1, 2)], "doc_id long, text string, score long, rank int")
    none = spark.createDataFrame([], "item_id long, text string, id long")
    assert lexical_search(some, none).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical_search(some, none).count() == 0
    long = [(1, "x " * 1_500_000 + "needle"), (2, "needle x"), (3, "y")]
    assert got(spark, long, [(7, "needle y")]) == plain(long, [(7, "needle y")])
    with pytest.raises(ValueError):
        lexical_search(some, items, index_bytes=2)
