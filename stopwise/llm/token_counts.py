"""Token counts of whole texts under a byte-level BPE vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.llm import bpe
from stopwise.llm.common import text_chunks

#: Pieces that this Python process has counted, by vocabulary.
_seen: dict[str, dict[str, int]] = {}


def count_tokens(vocab_path: str, texts: list[str | None]) -> list[int]:
    """Tokens of each text; null counts as empty. Special tokens in a text count as one."""
    vocab, seen = bpe.vocabulary(vocab_path), _seen.setdefault(vocab_path, {})
    if len(seen) > bpe.MEMORY:
        seen.clear()
    parts = [bpe.pieces(vocab, t) if t else [] for t in texts]
    new = list(set().union(*parts) - seen.keys()) if parts else []
    seen |= {p: len(ids) for p, ids in zip(new, bpe.encode_pieces(vocab, new), strict=True)}
    counts = [sum(map(seen.__getitem__, p)) for p in parts]
    for p in new:
        if len(p) > bpe.LETTERS:
            del seen[p]
    return counts


def token_counts(df: DataFrame, vocab_path: str, text: str = "text", key: str = "doc_id", limit: int = 1024) -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` for every row of ``df``.

    A null text counts as empty (0 bytes, 0 tokens). Repeated rows each give a row; an empty table
    gives none; other columns are ignored, whatever their names. Only the key and the text are read,
    nothing is shuffled, and a worker holds about 8 MB of text at a time, or one longer text.
    ``vocab_path`` must exist on the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text"):
            counts = count_tokens(vocab_path, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("n_bytes"), pa.array(counts, pa.int64())], ["key", "n_bytes", "n_tokens"])

    column: Column = df[text]
    rows = df.select(df[key].alias("key"), F.coalesce(F.octet_length(column), F.lit(0)).cast("long").alias("n_bytes"), column.alias("text"))
    kind = df.schema[key].dataType.simpleString()
    counted = rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
