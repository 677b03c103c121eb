"""Token counts of whole texts, as a public tokenizer library gives them.

The library runs in Arrow functions that return lengths only.  Texts are taken
in runs of about `shingles.CHUNK_BYTES` bytes, so a batch's work follows its
bytes and not its rows.  With `split_at_space` a text is cut at every run of
ASCII white space, which is safe for a tokenizer that drops white space before
it splits words (no piece, special token, composition or letter-case rule of it
reaches over a space): the counts of the parts add up to the count of the
whole.  A word's count is kept for the worker's life, up to `KEPT_WORDS` words,
so each distinct word is encoded about once; longer parts are encoded each time.
Without it, every text is encoded as a whole.

NULL reads as an empty text: 0 bytes, 0 tokens.  Repeated rows give repeated
rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import text_chunks

KEPT_WORDS = 600_000     # distinct words whose counts a worker keeps
KEPT_WORD_BYTES = 64     # longer parts are not kept
BATCH_BYTES = 1 << 18    # bytes handed to the library at once


@lru_cache(maxsize=2)
def _encoder(path: str) -> Callable[[list[str]], list[int]]:
    """Token counts of texts, with special strings read as the library's default."""
    if path.endswith(".model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark's tasks are the parallelism
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=2)
def _kept(path: str) -> dict[bytes, int]:
    return {}


def _encode(path: str, parts: list[bytes]) -> list[int]:
    """Counts of `parts`, handed over in batches of about BATCH_BYTES."""
    encode, out, batch, held = _encoder(path), [], [], 0
    for part in parts:
        batch.append(part.decode())
        held += len(part)
        if held >= BATCH_BYTES:
            out += encode(batch)
            batch, held = [], 0
    return out + (encode(batch) if batch else [])


def count_tokens(path: str, texts: list[bytes], split_at_space: bool) -> list[int]:
    if not split_at_space:
        return _encode(path, texts)
    kept = _kept(path)
    words = [t.split() for t in texts]
    new = set().union(*words).difference(kept) if words else set()
    if new:
        if len(kept) + len(new) > KEPT_WORDS:
            kept.clear()
            new = set().union(*words)
        counts = dict(zip(new, _encode(path, list(new)), strict=True))
        out = [sum(counts[w] if w in counts else kept[w] for w in ws) for ws in words]
        kept.update((w, n) for w, n in counts.items() if len(w) <= KEPT_WORD_BYTES)
        return out
    return [sum(map(kept.__getitem__, ws)) for ws in words]


def _count(path: str, split_at_space: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, raw, off in text_chunks(batch.column(1)):
                data = raw.tobytes()
                texts = [data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                tokens = count_tokens(path, texts, split_at_space)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(texts)), pa.array(np.diff(off)), pa.array(tokens, pa.int64())],
                    ["id", "n_bytes", "n_tokens"])
    return run


def token_counts(docs: DataFrame, path: str, split_at_space: bool, limit: int = 2048,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for every row of `docs`.

    `path` is the vocabulary file at the same place on every executor: `.json`
    for the tokenizers library, `.model` for sentencepiece.
    """
    counted = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _count(path, split_at_space), "id bigint, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
