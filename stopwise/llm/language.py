"""Language identification with hyperdimensional letter n-gram profiles.

Every letter has a fixed random vector of -1 and 1. The vector of a trigram binds the vectors of
its letters, each rolled by its distance from the end, by multiplication. A text bundles (adds) its
trigram vectors, each weighted by the square root of its count, in sixteenths so that sums are exact. A language's prototype bundles the
unit vectors of its training texts; a text gets the language of the prototype with the largest
cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.llm.common import text_chunks

DIMENSIONS = 512
#: Symbols: 0 is a word boundary, 1 to 26 are a to z, the others share the rest by code point.
SYMBOLS = 128
#: Unit vectors are summed as whole numbers of this many parts, so that sums do not depend on their order.
PARTS = 10_000
#: Trigram vectors that a process keeps; beyond that they are made anew.
KEPT = 40_000
#: Pairs of a text and a trigram that are bundled at once.
TOGETHER = 8192
#: Sharpness of the score.
SHARP = 12.0


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """The symbol of each code point (of lower-case text)."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if chr(cp).isalpha():
            table[cp] = cp - 96 if 97 <= cp <= 122 else 27 + cp % (SYMBOLS - 27)
    return table


class Trigrams:
    """Vectors of the trigrams that this process has met."""

    def __init__(self) -> None:
        self.letters = np.random.default_rng(20).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))
        self.clear()

    def clear(self) -> None:
        self.row = np.full(SYMBOLS**3, -1, np.int32)
        self.vectors = np.empty((0, DIMENSIONS), np.int8)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """The row of each distinct code in ``vectors``; new ones are made."""
        if len(self.vectors) > KEPT:
            self.clear()
        new = codes[self.row[codes] < 0]
        if len(new):
            a, b, c = new // SYMBOLS**2, new // SYMBOLS % SYMBOLS, new % SYMBOLS
            made = np.roll(self.letters[a], 2, axis=1) * np.roll(self.letters[b], 1, axis=1) * self.letters[c]
            self.row[new] = np.arange(len(self.vectors), len(self.vectors) + len(new))
            self.vectors = np.concatenate([self.vectors, made])
        return self.row[codes]

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """The unit vector of each text; zero without letters."""
        lower = [t.lower() if t else "" for t in texts]
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        points = np.frombuffer(("\0" + "\0".join(lower) + "\0").encode("utf-32-le", "replace"), np.uint32)
        doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lower])
        s = symbols()[points].astype(np.int32)
        keep = np.r_[True, (s[1:] > 0) | (s[:-1] > 0)]
        s, doc = s[keep], np.r_[np.int64(0), doc][keep]
        middle = np.flatnonzero(s[1:-1] > 0) + 1
        if not len(middle):
            return out
        codes = (s[middle - 1] * SYMBOLS + s[middle]) * SYMBOLS + s[middle + 1]
        pair, count = np.unique(doc[middle] * SYMBOLS**3 + codes, return_counts=True)
        weight = np.rint(16 * np.sqrt(count)).astype(np.float32)
        # so many pairs of text and trigram at a time, whatever the texts' lengths; their sums are whole numbers
        for lo in range(0, len(pair), TOGETHER):
            of, code = np.divmod(pair[lo : lo + TOGETHER], SYMBOLS**3)
            distinct, at = np.unique(code, return_inverse=True)
            weights = np.zeros((of[-1] - of[0] + 1, len(distinct)), np.float32)
            weights[of - of[0], at] = weight[lo : lo + TOGETHER]
            rows = self.rows(distinct)
            out[of[0] : of[-1] + 1] += weights @ self.vectors[rows].astype(np.float32)
        norm = np.sqrt(np.einsum("ij,ij->i", out, out, dtype=np.float64))
        return out / np.where(norm > 0, norm, 1)[:, None].astype(np.float32)


@lru_cache(maxsize=1)
def _trigrams() -> Trigrams:
    return Trigrams()


def prototypes(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """The unit prototype of each non-null language in ``df``, from all its rows.

    Each task sums its texts' vectors by language; Spark adds the sums. The result has
    ``DIMENSIONS`` numbers for each language, and as a label set it is small by nature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in text_chunks(batches, "text", 2 << 20):
            vectors = np.rint(_trigrams().bundle(part.column("text").to_pylist()) * PARTS).astype(np.int64)
            names = np.array(part.column("lang").to_pylist(), object)
            for name in set(names):
                sums[name] = sums.get(name, 0) + vectors[names == name].sum(axis=0)
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * DIMENSIONS, pa.string()), pa.array(range(DIMENSIONS), pa.int32()), pa.array(total)], ["lang", "dim", "value"]
            )

    rows = df.where(df[lang].isNotNull() & df[text].isNotNull()).select(df[text].alias("text"), df[lang].alias("lang"))
    sums = rows.mapInArrow(run, "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for r in sums.collect():
        found.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["dim"]] = r["value"]
    return {k: v / n for k, v in sorted(found.items()) if (n := np.sqrt(v @ v)) > 0}


def predict(df: DataFrame, learned: dict[str, np.ndarray], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of each row of ``df`` (all by default), then ``lang_pred``, ``score`` and ``cosine``.

    The score is the softmax share of the best cosine. ``und`` with score and cosine 0 for null
    texts, texts without a letter, and if nothing has been learned; ties go to the first language
    by name. ``keep`` may not hold the three result names. Repeated rows stay; an empty table gives
    none. A very long text is read whole, in a task by itself if need be.
    """
    names, matrix = sorted(learned), np.array([learned[k] for k in sorted(learned)]).reshape(-1, DIMENSIONS)
    keep = df.columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "_text", 2 << 20):
            vectors = _trigrams().bundle(part.column("_text").to_pylist())
            said, score, best = ["und"] * len(vectors), np.zeros(len(vectors)), np.zeros(len(vectors))
            if names:
                cosine = np.round(vectors.astype(np.float64) @ matrix.T, 9)
                first = cosine.argmax(axis=1)
                some = vectors.any(axis=1)
                share = 1 / np.exp(SHARP * (cosine - cosine.max(axis=1, keepdims=True))).sum(axis=1)
                said = [names[i] if s else "und" for i, s in zip(first, some, strict=True)]
                score, best = np.where(some, share, 0), np.where(some, cosine.max(axis=1), 0)
            kept = [part.column(i) for i in range(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(said, pa.string()), pa.array(score), pa.array(best)], [*keep, "lang_pred", "score", "cosine"])

    schema = df.select(keep).schema.add("lang_pred", "string").add("score", "double").add("cosine", "double")
    return df.select(*keep, df[text].alias("_text")).mapInArrow(run, schema)


def fold(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % of


def identify(df: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", folds: int = 5) -> DataFrame:
    """``(key, held_out, lang_pred, score)`` for each row: learned from the rows outside fold 0."""
    held = fold(df[key], folds) == 0
    learned = prototypes(df.where(~held), text, lang)
    rows = df.select(df[key].alias(key), held.alias("held_out"), df[text].alias(text))
    return predict(rows, learned, text, [key, "held_out"])
