import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelkit.llm import op10_decontamination as op10
from panelkit.llm.op9_line_templates import drop_recurring_lines
from panelkit.llm.op10_decontamination import ItemIndex, block_max_wand, drop_leaks, find_leaks


@settings(max_examples=300, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 60), st.floats(0.01, 1), min_size=1, max_size=40), max_size=6),
       st.floats(0.05, 2))
def test_block_max_wand_is_exhaustive(lists, least):
    total: dict[int, float] = {}
    for x in lists:
        for i, w in x.items():
            total[i] = total.get(i, 0) + w
    near = {i for i, w in total.items() if abs(w - least) < 1e-9}
    want = {i for i, w in total.items() if w >= least} - near
    got = block_max_wand([(sorted(x), [x[i] for i in sorted(x)]) for x in lists], least)
    assert {i for i, _ in got} - near == want
    assert all(abs(w - total[i]) < 1e-9 for i, w in got)


LETTERS = str.maketrans("0123456789", "ghijklmnop")


def corpus():
    rng = np.random.default_rng(3)
    vocabulary = ["t%d" % k for k in range(300)] + ["the", "of", "and"] * 30
    text = lambda n: " ".join(str(x) for x in rng.choice(vocabulary, n))
    items = [(k, (text(int(rng.integers(6, 30))) + ". " + text(int(rng.integers(1, 6))) + ".").capitalize()) for k in range(40)]
    docs = [(k, text(int(rng.integers(1, 400)))) for k in range(60)]
    for k in range(20):
        words = text(200).split()
        at = int(rng.integers(0, 200))
        docs.append((100 + k, " ".join(words[:at]) + "\n" + items[k][1].upper().replace(" ", "  ") + "\n" + " ".join(words[at:])))
    half = items[30][1].split()
    docs += [(200, None), (201, ""), (202, "."), (203, " ".join(half[:len(half) // 3]))]
    return docs, items + [(90, None), (91, ""), (92, "solitary"), (0, items[0][1])]


def test_leaks_found_and_clean_documents_left(spark, monkeypatch):
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = find_leaks(d, b).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert {(100 + k, k) for k in range(20)} <= got
    # brute force: every window of every document against every item
    index = ItemIndex(sorted({(i, t) for i, t in items if t}), 0.6)
    want = set()
    for i, t in docs:
        h = op10._hash_words(t or "")
        for a in range(0, max(1, len(h)), index.span):
            if a and len(h) - a <= index.span:
                break
            part = h[a:a + 2 * index.span]
            have = set(index.terms(part).tolist()) - {-1}
            for k, item in enumerate(index.ids):
                score = sum(w for x in have for j, w in zip(*index.postings(x), strict=True) if j == k)
                width, q, ans = index.parts[k]
                here = op10.grams(part, width)
                if score >= 0.6 - 1e-9 and all(not len(p) or np.isin(p, here).mean() >= 0.5 for p in (q, ans)):
                    want.add((i, item))
    assert got == want
    assert {r.doc_id for r in drop_leaks(d, b).select("doc_id").collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_cut_indexes_give_the_same(spark):
    """A benchmark above the bound is cut into several indexes; scores are of all items."""
    docs, items = corpus()
    # one item id with a third of all texts, in parts of their own
    items = items + [(7, f"{t} {i}") for i, t in items[:20] if t]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items + items[:5], "item_id long, text string").withColumn("part", F.lit(1))
    for score, overlap in ((0.2, 0.0), (0.6, 0.5)):
        one, many = (sorted(map(tuple, find_leaks(d, b, score, overlap, index_bytes=size).collect())) for size in (16 << 20, 900))
        assert len(one) >= 20 and [r[:2] for r in one] == [r[:2] for r in many]
        np.testing.assert_allclose([r[2:] for r in one], [r[2:] for r in many])


def test_leak_in_a_very_long_document(spark):
    leak = "Which river runs through the old town of Eastmere? The broad river Tamsin."
    long = " ".join(f"w{k % 5000}" for k in range(300_000))
    d = spark.createDataFrame([(1, f"{long}\n{leak}\n{long}"), (2, long)], "doc_id long, text string")
    b = spark.createDataFrame([(1, leak), (2, "Some other question with words? An answer too.")], "item_id long, text string")
    assert [tuple(r) for r in find_leaks(d, b).select("doc_id", "item_id").collect()] == [(1, 1)]


def test_leaks_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(d, none).collect() == []
    assert find_leaks(d.limit(0), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).collect() == []
    assert drop_leaks(d, none).count() == 1


def word(*parts):
    return hashlib.md5(repr(parts).encode()).hexdigest().translate(LETTERS)


def test_recurring_lines(spark):
    rows = []
    for k in range(6):
        own = "\n".join(f"own {word(k, j)} of {word(j, k)}y {'abcdefgh'[j]} x{'z' * j}" for j in range(3))
        rows.append((k, f"Read more on page {k} of 20\n{own}\nAll rights reserved.\n\n  All\trights   reserved."))
    long = "this long line names the sender {} and asks for an answer by the end"
    rows += [(10 + k, f"{long.format(n)}\nsomething new {n} came {n * 2} here\n{n} says {n * 2}") for k, n in enumerate(["ann", "bob", "cy"])]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, "All rights reserved."), (24, "same text here\nand here too then"),
             (25, "same text here\nand here too then"), (26, "same text here\nand here too then"), (None, "All rights reserved.")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_lines int")
    got = {r.doc_id: r for r in drop_recurring_lines(docs).collect()}
    for k in range(6):
        assert got[k].n_dropped == 3 and got[k].n_lines == 7
        assert re.fullmatch(r"(own .*\n){3}", got[k].text)
    for k in (10, 11, 12):
        assert got[k].n_dropped == 1 and got[k].text.startswith("something new")
    assert got[20].text is None and got[21].text == "" and got[22].text == "\n\n"
    # recurring lines go from every text, with or without an id or other lines
    assert all(got[k].n_dropped == 1 and got[k].text == "" for k in (23, None))
    # copies are one text, so their lines do not recur
    assert all(got[k].n_dropped == 0 for k in (24, 25, 26))
    assert drop_recurring_lines(docs.limit(0)).collect() == []
    assert sorted(drop_recurring_lines(docs).columns) == ["doc_id", "n_dropped", "n_lines", "text"]


def test_recurring_lines_equal_a_plain_count(spark):
    """Every template of every line counted over distinct texts, in Python."""
    rng = np.random.default_rng(8)
    words = [word(k)[:5] for k in range(40)]
    forms = [[words[j] for j in rng.integers(0, 40, n)] for n in (3, 4, 5, 7, 9, 10, 11, 14, 19, 20, 23, 31) for _ in range(2)]
    rows = []
    for k in range(60):
        lines = []
        for form in (forms[j] for j in rng.integers(0, len(forms), int(rng.integers(1, 9)))):
            line = list(form)
            for _ in range(int(rng.integers(0, 4))):
                at = int(rng.integers(0, len(line)))
                line[at] = words[int(rng.integers(0, 40))] if rng.random() < 0.6 else f"n{k}"
            lines.append("  ".join(line) if rng.random() < 0.2 else " ".join(line))
        rows.append((k, "\n".join(lines)))
    rows += [(100 + k, rows[k][1]) for k in range(20)] + [(200, None), (None, rows[3][1]), (201, " ".join(words * 3000))]

    def templates(line):
        w = re.findall(r"[^\x20\x09-\x0D]+", line)
        w = ["<*>" if re.search("[0-9]", x) else x for x in w]
        n = len(w)
        if n < 3:
            return n, []
        part = [tuple(w[n * k // 5:n * (k + 1) // 5]) for k in range(5)]
        gone = [(a, b) for a in range(5) for b in range(a)] if n >= 10 else [
            (k,) for k in range(5) if part[k] and n - len(part[k]) >= 3]
        return n, [(n, "whole", tuple(w))] + [(n, g, tuple(p for k, p in enumerate(part) if k not in g)) for g in gone]

    texts = {t for _, t in rows if t is not None}
    place = {t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16) for t in texts}
    held = {}
    for t in texts:
        for line in t.split("\n"):
            for x in templates(line)[1]:
                held.setdefault(x, set()).add(place[t])
    often = {x: min(p) for x, p in held.items() if len(p) >= (2 if x[1] == "whole" and x[0] >= 20 else 3)}

    def kept(t):
        out = []
        for line in t.split("\n"):
            n, under = templates(line)
            first = [often[x] for x in under if x in often]
            if not (first and (n < 20 or place[t] > min(first))):
                out.append(line)
        return "\n".join(out)

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, drop_recurring_lines(docs).select("doc_id", "text").collect()), key=str)
    want = sorted([(i, None if t is None else kept(t)) for i, t in rows], key=str)
    assert got == want
    assert 20 < sum(t != kept(t) for t in texts) < len(texts)
