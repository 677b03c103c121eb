import pytest

import corpus_pipeline
from panelkit.llm import op10_decontamination as op10
from panelkit.llm.op8_quality_rules import quality_rules
from panelkit.session import stage_table

from .test_op2 import brute

SF = "/root/testdata/sf0.001"


def test_stages_on_their_own_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}
    good = stages["quality_rules"](spark, docs, SF)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in quality_rules(docs).filter("kept").select("doc_id").collect()}
    assert {r.doc_id for r in good.collect()} == kept and 0 < len(kept) < len(rows)
    lines = stages["line_dedup"](spark, docs, SF)
    assert lines.columns == docs.columns and lines.count() == len(rows)
    for r in lines.collect():
        old = rows[r.doc_id].text.split("\n")
        assert r.n_chars == len(r.text) and all(x in old for x in r.text.split("\n") if x)
    joined = stages["ngram_join"](spark, docs, SF)
    want = {c for _, c in brute([(i, r.text) for i, r in rows.items()], 5, 80).values()}
    assert {r.doc_id for r in joined.collect()} == want
    clean = stages["decontamination"](spark, docs, SF)
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [" ".join(r.text.split()) for r in clean.collect()]
    assert not any(i in t for t in left for i in items)
    leaks = op10.find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).select("doc_id").distinct().count()
    assert len(left) == len(rows) - leaks


def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage_table(stage(spark, docs, SF), f"test-{name}")
    assert sorted(docs.collect(), key=str) == sorted(corpus_pipeline.run(spark, SF).collect(), key=str)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_no_rows(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, SF).collect() == []


def test_line_dedup_drops_boilerplate_in_every_document(spark):
    own = ["amber birds circle", "dry leaves settle", "old maps crumble", "quiet rivers bend"]
    rows = [(k, f"Sign up today please\n{x}\nFollow us on radio") for k, x in enumerate(own)]
    # exact copies are one text, however many ids they have
    rows += [(10 + k, "copied words stand here\nand others follow them") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()}
    assert got == dict(enumerate(own)) | {10 + k: rows[4][1] for k in range(3)}


def test_line_dedup_word_fields_at_every_position(spark):
    words = "this long notice goes out to all our readers before the next issue comes".split()
    rows = []
    names = ["ann", "bob", "cy"]
    for at in range(len(words)):
        line = [f"{w}{chr(97 + at)}" for w in words]     # a notice of its own for every place
        rows += [(100 * at + k, " ".join([*line[:at], name, *line[at + 1:]])) for k, name in enumerate(names)]
    pair = [f"{w}zz" for w in words]
    rows += [(5000 + k, " ".join([*pair[:4], name, *pair[5:11], name[::-1], *pair[12:]])) for k, name in enumerate(names)]
    rows += [(6000 + k, f"written by {name} yesterday") for k, name in enumerate(names)]
    kept = [(7000 + k, f"{name} walks home\n{name * 2} sleeps {name}ly") for k, name in enumerate(["dee", "eve"])]
    docs = spark.createDataFrame(rows + kept, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()}
    assert got == {i: "" for i, _ in rows} | dict(kept)


def test_line_dedup_long_lines_recur_from_two_texts(spark):
    long = " ".join(f"w{'abcdefghijklmnopqrstuvwxyz'[k]}x" for k in range(24))
    wide = " ".join(f"v{'abcdefghijklmnopqrstuvwxyz'[k]}x" for k in range(24))
    short = "two texts share this one"
    rows = [(k, f"{long}\n{short}\n{x}") for k, x in enumerate(["amber birds circle", "dry leaves settle"])]
    rows += [(10 + k, f"{wide}\n{x}") for k, x in enumerate(["old maps crumble", "quiet rivers bend", "thin ice cracks"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()}
    for line, ids in ((long, (0, 1)), (wide, (10, 11, 12))):
        assert sum(line in got[k] for k in ids) == 1             # one occurrence stays
    for k, text in rows:
        assert got[k] in (text, text.split("\n", 1)[1])


def test_repeated_and_null_ids(spark, tmp_path):
    leak = "Which river runs through the old town of Eastmere? The broad river Tamsin."
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    base = " ".join(f"word{k}" for k in range(60))
    rows = [(1, base), (1, "another text altogether under the same id as before it"), (2, base + " more"), (None, base + " tail"),
            (None, "a text of its own without any id stands here"), (None, f"some quite other words come first here, eight of them\n{leak}\nand they end it"), (3, f"and then\n{leak}"),
            (3, "clean words under an id whose other text holds a leak")]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string")
    near = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(map(tuple, near.collect()), key=str) == sorted([r for r in rows if r not in (rows[2], rows[3])], key=str)
    clean = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert sorted(map(tuple, clean.collect()), key=str) == sorted([r for r in rows + rows[:1] if leak not in r[1]], key=str)


def test_stages_carry_columns_of_any_name(spark, tmp_path):
    leak = "Which river runs through the old town of Eastmere? The broad river Tamsin."
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    own = " ".join(f"the word{k} of a{k}" for k in range(40))
    names = ["n_lines", "n_dropped", "row", "row_key", "row_key_", "key", "_row", "id", "component_id", "n_words", "kept", "drop", "lines", "size"]
    rows = [(1, own, "src", *range(len(names))), (2, f"{leak} the of {own[::-1]}", None, *range(10, 10 + len(names)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        kept = {tuple(r) for r in out.collect()}
        assert rows[0] in kept and kept <= set(rows), name
    assert {r.doc_id for r in corpus_pipeline.mix(spark, docs, str(tmp_path)).collect()} == {1, 2}
