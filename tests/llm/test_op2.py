import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelkit.llm import op2_ngram_join as op
from panelkit.llm.op2_ngram_join import ListIndex, merge_skip, ngram_join

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x]:
                common = len(sets[x] & sets[y])
                if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                    a, b = root(x), root(y)
                    up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies():
    rng = np.random.default_rng(5)
    words = ["w%d" % k for k in range(60)]
    rows, at = [], 0
    for base in range(12):
        text = [str(rng.choice(words)) for _ in range(int(rng.integers(3, 60)))]
        for _ in range(6):
            copy = list(text)
            for _ in range(int(rng.integers(0, 3))):
                copy[int(rng.integers(0, len(copy)))] = str(rng.choice(words)).upper()
            rows.append((at, " \t".join(copy)))
            at += 1
    return rows + [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "one two"),
                   (906, "Ünï 中文 x y z"), (907, "ünï 中文 x y z"), (908, "a b " * 4000), (909, "a b " * 3000)]


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_like_brute_force(spark, width, percent):
    rows = near_copies()
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, component_id int, n string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(docs, width, percent).collect()}
    assert got == brute(rows, width, percent)


def test_groups_cut_into_blocks_give_the_same(spark, monkeypatch):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(op, "GROUP_SHINGLES", 40)
    monkeypatch.setattr(op, "GROUP_CLASSES", 3)
    monkeypatch.setattr(op, "LONG_LEVEL", -1)
    monkeypatch.setattr(op, "LONG_FROM", 0)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(docs, 4, 85).collect()}
    assert got == brute(rows, 4, 85)


def test_empty_table_nulls_and_repeats(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join(docs, 4, 85).collect() == []
    docs = spark.createDataFrame([(None, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (3, "a b c d e")],
                                 "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(docs, 4, 85).collect()), key=str)
    assert got == [(2, 2, 2), (2, 2, 2), (3, 2, 2), (None, 2, None)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30)).map(sorted), max_size=8), st.integers(1, 5))
def test_merge_skip(lists, least):
    want = {d: sum(d in s for s in lists) for s in lists for d in s}
    assert list(merge_skip(lists, least)) == sorted((d, c) for d, c in want.items() if c >= least)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), min_size=1, max_size=8), st.integers(51, 100))
def test_search(sets, percent):
    index = ListIndex([np.array(sorted(s), dtype=np.uint64) for s in sets])
    for s in sets:
        want = [k for k, o in enumerate(sets) if 100 * len(s & o) >= percent * len(s | o)]
        assert sorted(index.search(np.array(sorted(s), dtype=np.uint64), percent)) == want


def dense_group(members=2_000, size=400):
    """Near copies: every list holds most of the group."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 62, size).astype(np.uint64)
    sets = []
    for _ in range(members):
        s = base.copy()
        new = rng.choice(size, int(rng.integers(5, 60)), replace=False)
        s[new] = rng.integers(0, 1 << 62, len(new)).astype(np.uint64)
        sets.append(np.unique(s))
    return sets


def test_dense_lists_are_counted_at_once_and_probed_like_before():
    sets = dense_group()
    index = ListIndex(sets)
    before = time.process_time()
    found = [index.search(s, 85) for s in sets[:60]]
    assert time.process_time() - before < 4           # about 10 s on a heap
    for s, got in zip(sets[:60:12], found[::12]):
        common = np.array([len(np.intersect1d(s, o, assume_unique=True)) for o in sets])
        union = np.array([len(s) + len(o) for o in sets]) - common
        assert list(got) == np.flatnonzero(100 * common >= 85 * union).tolist()


@pytest.mark.parametrize("heap,probe", [(0, 0), (0, 1 << 40), (1 << 40, 0), (1 << 40, 1 << 40)])
def test_heap_counts_and_probes_agree(monkeypatch, heap, probe):
    monkeypatch.setattr(op, "HEAP_ENTRIES", heap)
    monkeypatch.setattr(op, "PROBE_COST", probe)
    sets = dense_group(40, 60) + dense_group(5, 90) + [np.arange(3, dtype=np.uint64), np.zeros(0, np.uint64)]
    index = ListIndex(sets)
    for s in sets:
        want = [k for k, o in enumerate(sets) if len(s) and len(o) and
                100 * (c := len(np.intersect1d(s, o))) >= 70 * (len(s) + len(o) - c)]
        assert list(index.search(s, 70)) == want


def test_joined_counts_components_and_names_each_new_link_once():
    j = op._Joined(6)
    assert j.join(0, np.array([0, 1, 2])) == [1, 2] and j.left == 4
    assert j.join(1, np.array([0, 2])) == []
    assert j.join(4, np.array([5])) == [5]
    assert j.join(5, np.array([0, 1, 4])) == [0] and j.left == 2
    assert len(set(j.label[[0, 1, 2, 4, 5]].tolist())) == 1 and j.label[3] != j.label[0]
