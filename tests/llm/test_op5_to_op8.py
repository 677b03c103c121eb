import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.llm import op5_token_counts as op5
from panelkit.llm.op5_token_counts import token_counts
from panelkit.llm.op6_mixing import mix_sources, schedule, source_targets
from panelkit.llm.op7_language import codewords, fit, identify
from panelkit.llm.op8_quality_rules import keep_good, quality_rules

public_tokenizers = pytest.importorskip("public_tokenizers")

TEXTS = [(1, "Hello, world! It's 2024 — naïve café's\tend\n\nnext"), (2, None), (3, ""), (4, " \n "), (5, "word " * 3000),
         (6, "<|endoftext|> a <|startoftext|>b<|endoftext|> <|ENDOFTEXT|> <|endof text|>"), (7, "中文 テスト한국어 ǅ İ ΑΣ ς"),
         (8, "é ́x ́\ń"), (9, "a b c\x85d\x1cd\x0be\x0cf"), (10, "x" * 5000), (11, "🙂👩‍👩‍👧 ok"), (5, "word " * 3000)]


@pytest.mark.parametrize("name,split", [("word_bpe_49k.json", True), ("word_bpe_49k.json", False), ("byte_bpe_50k.json", False),
                                        ("piece_bpe_32k.model", False)])
def test_token_counts_like_the_library(spark, monkeypatch, name, split):
    path = public_tokenizers.path(name)
    docs = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, path, split, limit=2000).collect())
    if name.endswith(".model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    want = sorted((i, len((t or "").encode()), count(t or ""), count(t or "") > 2000) for i, t in TEXTS)
    assert got == want
    assert token_counts(docs.limit(0), path, split).collect() == []


def test_kept_counts_are_bounded_and_right():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [f"w{k} v{k % 7} {'long' * 30}".encode() for k in range(200)]
    plain = op5._encode(path, texts)
    old, op5.KEPT_WORDS = op5.KEPT_WORDS, 50
    try:
        op5._kept(path).clear()
        got = [n for k in range(0, 200, 10) for n in op5.count_tokens(path, texts[k:k + 10], True)]
        assert got == plain and len(op5._kept(path)) <= 50
    finally:
        op5.KEPT_WORDS = old


def mixed(spark):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 300))), f"s{k % 5}" if k % 3 else "s0") for k in range(400)]
    return rows + [(900, None, "s1"), (901, "a b", None), (902, "c d e", None), (903, "", "empty"), (None, "x y z", "s2"), (7, rows[7][1], rows[7][2])]


def water(sizes, weights, amount, cap):
    target = dict.fromkeys(sizes, 0.0)
    open_, left = {s for s in sizes if sizes[s]}, amount * sum(sizes.values())
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            target.update(share)
            return target
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark):
    rows = mixed(spark)
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, size int")
    found = mix_sources(docs, block=16).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _, _ in rows)
    words = {}
    for _, t, s in rows:
        words[s] = words.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in words if s is not None), key=lambda s: s.encode()) + [None]
    target = water(words, {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}, 1.5, 2)
    taken = Counter()
    for r in found:
        assert r.source_size == words[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(-1 < target[s] - taken[s] <= 3 * 16 for s in words)
    assert all((r.first_slot is not None) == (r.taken > 0) for r in found)
    again = mix_sources(docs.repartition(7), block=16).collect()
    assert sorted(found, key=str) == sorted(again, key=str)
    # the schedule decides: other points serve other documents, or later
    short = sum(target.values()) - sum(taken.values())
    for step in (0.5 ** 0.5, 0.377):
        other = mix_sources(docs, block=16, step=step).collect()
        assert [r.target for r in sorted(other, key=str)] == [r.target for r in sorted(found, key=str)]
        assert {(r.doc_id, r.first_slot) for r in other} != {(r.doc_id, r.first_slot) for r in found}
        assert {(r.doc_id, r.taken) for r in other} != {(r.doc_id, r.taken) for r in found}
        assert sum(target.values()) - sum(r.taken for r in other) >= 0 <= short
    assert mix_sources(docs.limit(0)).collect() == []
    nothing = mix_sources(docs.filter("doc_id in (900, 903)")).collect()
    assert [(r.size, r.taken, r.target) for r in nothing] == [(0, 0, 0.0)] * 2


def test_schedule_has_low_discrepancy(spark):
    targets = spark.createDataFrame([("a", 50_000.0), ("b", 30_000.0), (None, 20_000.0)], "source string, target double")
    rows = sorted(schedule(targets, 100).collect())
    assert sorted((str(r.source), r["rank"]) for r in rows) == sorted(
        [("a", k) for k in range(500)] + [("b", k) for k in range(300)] + [("None", k) for k in range(200)])
    seen = Counter()
    for n, r in enumerate(rows, 1):
        seen[r.source] += 1
        assert all(abs(seen[s] - n * w) < 6 for s, w in (("a", 0.5), ("b", 0.3), (None, 0.2)))


def test_targets_of_no_sources(spark):
    assert source_targets(spark.createDataFrame([], "source string, source_size long")).collect() == []


def test_codewords():
    assert codewords(4).shape == (4, 7) and codewords(1).shape == (1, 1)
    for n in (2, 3, 5, 12):
        code = codewords(n)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= max(1, code.shape[1] // 4)


def test_languages(spark):
    rng = np.random.default_rng(1)
    parts = {"en": "the ing and tion er wh ou".split(), "de": "sch der ung ei lich ß ü".split(), "fr": "le eau ç que ment è".split()}
    rows = [(k, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(60)), lang)
            for k, lang in enumerate(["en", "de", "fr"] * 80)]
    rows += [(900, None, "en"), (901, "", "de"), (902, "12 .. 34", "fr"), (903, "the ing", None), (None, rows[0][1], "de"), (0, rows[0][1], "en")]
    docs = spark.createDataFrame([(i, t, g, 0.5) for i, t, g in rows], "doc_id long, text string, lang string, score double")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = fit(docs, rest != 2, rows_per_language=40)
    found = identify(docs, model, rest == 2).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    own = [(r.lang_pred, rows[r.doc_id][2]) for r in found if r.held_out and r.doc_id < 240]
    assert len(own) > 30 and sum(a == b for a, b in own) / len(own) > 0.97
    assert all((by_id[k].lang_pred, by_id[k].score) == ("und", 0.0) for k in (900, 901, 902))
    assert by_id[None].lang_pred == "en" and not by_id[None].held_out and by_id[903].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in found)
    # the label, id and other columns are no inputs of a prediction
    blind = identify(docs.select(F.lit(5).alias("doc_id"), "text"), model).collect()
    assert Counter(r.lang_pred for r in blind) == Counter(r.lang_pred for r in found)
    nothing = fit(docs, F.lit(False))
    assert {r.lang_pred for r in identify(docs, nothing).collect()} == {"und"}
    assert identify(docs.limit(0), model).collect() == []


def brute_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for k in range(len(w) - 2) if c[tuple(w[k:k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), base)


def test_quality_rules(spark):
    clean = " ".join(f"word{chr(97 + k % 26)}{k} the" for k in range(60))
    rows = [(1, clean), (2, None), (3, ""), (4, " \t\n"), (5, "a b c a b c a"), (6, "x | y | z\n" * 40), (7, clean.upper() + "!"),
            (8, clean.replace(" ", "## ")), (9, "a " * 100), (10, clean + "\n\x0b\x0c\r ü 中文 🙂\n" + clean), (11, "same line here\nsame line here\n \nsame"),
            (12, " ".join(f"q{k}z" for k in range(5000))), (None, clean), (1, clean), (13, "Voilà la été ÉÀ " * 3)]
    docs = spark.createDataFrame([(i, t, 9, "k") for i, t in rows], "doc_id long, text string, n_words int, kept string")
    found = sorted(quality_rules(docs).collect(), key=str)
    got = Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in found)
    assert got == Counter((i, brute_quality(t)) for i, t in rows)
    kept = {r.doc_id for r in found if r.kept}
    assert kept == {1, None} and not any(r.kept and r.base_failed for r in found)
    good = keep_good(docs)
    assert good.columns == docs.columns and sorted(str(r.doc_id) for r in good.collect()) == ["1", "1", "None"]
    assert quality_rules(docs.limit(0)).collect() == [] and keep_good(docs.limit(0)).collect() == []


def test_filters_on_the_rules_hold_no_copies_of_the_measures(spark, capsys):
    docs = spark.createDataFrame([(1, "the a b. " * 60), (2, "x"), (3, None)], "doc_id long, text string")
    for condition in ("kept", "base_failed", "n_words > 50", "not kept and n_symbols = 0"):
        kept = quality_rules(docs).filter(condition)
        kept.explain()
        assert capsys.readouterr().out.count("array_remove") == 1
    assert {r.doc_id for r in quality_rules(docs).filter("base_failed").collect()} == {1, 2, 3}


def test_stray_labels_are_not_learned(spark):
    rows = [(k, "the ing and tion wh ou", "en") for k in range(20)] + [(100 + k, "sch der ung lich", "de") for k in range(20)]
    rows += [(200 + k, "le eau que ment", f"stray {k}") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert fit(docs, F.lit(True), most_languages=2).languages == ("de", "en")
    assert fit(docs, F.lit(True), most_languages=3).languages == ("de", "en", "stray 0")
