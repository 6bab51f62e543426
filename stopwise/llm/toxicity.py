"""Toxicity by a support vector machine with a gapped subsequence kernel and Nyström landmarks.

The kernel of two words counts their common subsequences of three letters, each weighted by a decay
to the power of its spread, so an insult with letters or signs put in between stays near itself. The
machine is trained on words in the Nyström space of some landmark words. Its decision is linear in
the subsequences, so it is folded into one weight for each three letters, and a word is scored by
adding weights. A text's score is a logistic function of its most suspicious words.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.llm.common import text_chunks
from stopwise.llm.language import fold

#: Symbols: 0 marks a word's ends, 1 to 26 are a to z, the rest share the other letters.
SYMBOLS = 32
DECAY = 0.6
#: Spread of a subsequence at most, in letters.
SPREAD = 6
#: Letters of a word that count at most: the middle of a longer one is scored in pieces of this length.
LETTERS = 40
LANDMARKS = 160
#: Labelled rows to learn from, at most, of each label.
TOXIC_ROWS, CLEAN_ROWS = 2000, 3000
#: Signs that stand for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
SPACED = re.compile(r"(?:(?<=\s)|^)(?:[^\W\d_]\s){2,}[^\W\d_](?=\s|$)")
STEPS = [(a, b, DECAY ** (a + b + 1)) for a in range(1, SPREAD) for b in range(1, SPREAD - a + 1)]
FEATURES = 5


def _symbols() -> np.ndarray:
    """Symbol of each code point in lower case, -1 for what is dropped."""
    table = np.full(0x110000, -1, np.int8)
    for cp in range(len(table)):
        c = STAND_INS.get(chr(cp), chr(cp))
        if c.isalpha():
            table[cp] = ord(c) - 96 if "a" <= c <= "z" else 27 + cp % (SYMBOLS - 27)
    return table


_table = _symbols()


def words_of(text: str) -> list[str]:
    """Lower-case words of a text between white space; letters that stand alone in a row count as a word too."""
    low = text.lower()
    found = [w[:LETTERS] if len(w) > LETTERS else w for w in low.split()]
    for w in [w for w in low.split() if len(w) > LETTERS]:
        found += [w[i : i + LETTERS] for i in range(LETTERS // 2, len(w), LETTERS // 2)]
    return found + [re.sub(r"\s", "", m) for m in SPACED.findall(low)]


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each step pattern: word number and three-letter code of every subsequence, and its weight over the norm is the kernel's."""
    lengths = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)
    s = _table[points].astype(np.int32)
    unit = np.repeat(np.arange(len(words)), lengths)
    unit, s = unit[s >= 0], s[s >= 0]
    counts = np.bincount(unit, minlength=len(words))
    # an end mark before and after each word
    at = np.arange(len(s)) + 2 * unit + 1
    codes = np.zeros(len(s) + 2 * len(words), np.int32)
    codes[at] = s
    unit = np.repeat(np.arange(len(words)), counts + 2)
    for a, b, weight in STEPS:
        n = max(0, len(codes) - a - b)
        keep = unit[:n] == unit[a + b :]
        yield unit[:n][keep], ((codes[:n] * SYMBOLS + codes[a : a + n]) * SYMBOLS + codes[a + b :])[keep], weight


def _norms(words: list[str], parts: list) -> np.ndarray:
    total = np.zeros(len(words))
    for unit, _, weight in parts:
        total += np.bincount(unit, minlength=len(words)) * weight**2
    return np.sqrt(np.maximum(total, 1e-12))


def margins(words: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """The machine's decision for each word, some thousand words at a time."""
    if len(words) > 20_000:
        return np.concatenate([margins(words[i : i + 20_000], weights, bias) for i in range(0, len(words), 20_000)])
    total = np.zeros(len(words))
    parts = list(subsequences(words))
    for unit, code, weight in parts:
        total += np.bincount(unit, weights[code] * weight, minlength=len(words))
    return total / _norms(words, parts) + bias


def embed(words: list[str]) -> np.ndarray:
    """Words as unit rows over all three-letter codes; for a few words only."""
    out = np.zeros((len(words), SYMBOLS**3), np.float32)
    parts = list(subsequences(words))
    for unit, code, weight in parts:
        np.add.at(out, (unit, code), weight)
    return out / _norms(words, parts)[:, None].astype(np.float32)


def _kernel(words: list[str], landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of words with landmark rows."""
    return np.concatenate([embed(words[i : i + 250]) @ landmarks.T for i in range(0, len(words), 250)])


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by Newton steps; the last is the bias."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(30):
        on = y * (x @ w) < 1
        xs = x[on] * weight[on, None]
        new = np.linalg.solve(xs.T @ x[on] + np.diag(keep), xs.T @ y[on])
        if np.allclose(new, w, atol=1e-8):
            break
        w = 0.5 * w + 0.5 * new
    return w


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    logistic: np.ndarray

    def features(self, texts: list[list[str]], known: dict[str, float]) -> np.ndarray:
        """A row for each text: the largest margins, and how many words and what part of them are suspicious."""
        new = list(set().union(*texts) - known.keys())
        known.update(zip(new, margins(new, self.weights, self.bias).tolist(), strict=True))
        out = np.zeros((len(texts), FEATURES))
        out[:, :2] = -2
        for row, words in zip(out, texts, strict=True):
            if words:
                m = np.fromiter(map(known.__getitem__, words), float, len(words))
                hot = int((m > 0).sum())
                top = np.sort(np.partition(m, -2)[-2:])[::-1] if len(m) > 1 else np.array([m[0], -2])
                row[:] = *np.maximum(top, -2), np.log1p(hot), 10 * hot / (len(m) + 10), hot > 0
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.logistic[:-1] + self.logistic[-1], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic function, none of them negative, so that more evidence never lowers a score; the last is the bias."""
    used = list(range(x.shape[1]))
    while True:
        z = np.c_[x[:, used], np.ones(len(x))]
        w = np.zeros(z.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            new = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(len(w)), z.T @ (y - p) - 0.05 * w)
            if np.allclose(new, w, atol=1e-6):
                break
            w = new
        if (w[:-1] >= 0).all():
            out = np.zeros(x.shape[1] + 1)
            out[used], out[-1] = w[:-1], w[-1]
            return out
        used = [u for u, v in zip(used, w[:-1], strict=True) if v >= 0]


def fit(toxic: list[str], clean: list[str], seed: int = 5) -> Model:
    """Learn from the texts of labelled rows. Without texts of both labels every score is 0.

    Words that stand in toxic texts far more often than in clean ones begin as positive examples;
    then each toxic text's most suspicious words take their place. Texts that repeat count once.
    """
    rng = np.random.default_rng(seed)
    pos, neg = ([[*map(sys.intern, words_of(t))] for t in sorted(set(x))] for x in (toxic, clean))
    nothing = Model(np.zeros(SYMBOLS**3), -1.0, np.r_[np.zeros(FEATURES), -30.0])
    if not pos or not neg:
        return nothing
    in_pos, in_neg = Counter(w for t in pos for w in set(t)), Counter(w for t in neg for w in set(t))
    p, n = len(pos), len(neg)
    # how much likelier a word is in a toxic text, shrunk towards not at all
    gain = {w: c * np.log((c / p) / ((in_neg[w] + 0.5) / n)) for w, c in in_pos.items() if c > 1 and c / p > 3 * (in_neg[w] + 0.5) / n}
    seeds = sorted(gain, key=lambda w: (-gain[w], w))[:400]
    if not seeds:
        return nothing
    others = sorted(in_neg, key=lambda w: (-in_neg[w], w))
    negatives = list(dict.fromkeys(others[:1500] + [others[i] for i in rng.permutation(len(others))[:4500]]))
    negatives = [w for w in negatives if w not in gain]
    weights, bias = None, 0.0
    for _ in range(3):
        if weights is not None:  # the most suspicious words of each toxic text are its evidence
            seen: dict[str, float] = {}
            every = list(in_pos)
            seen = dict(zip(every, margins(every, weights, bias).tolist(), strict=True))
            taken = Counter()
            for words in pos:
                best = sorted(set(words), key=lambda w: (-seen[w], w))[:4]
                taken.update(w for i, w in enumerate(best) if seen[w] > 0 or i == 0)
            seeds = [w for w, c in sorted(taken.items(), key=lambda x: (-x[1] * np.log((in_pos[x[0]] / p) / ((in_neg[x[0]] + 0.5) / n)), x[0])) if in_pos[w] / p > 3 * (in_neg[w] + 0.5) / n][:800]
            hard = dict(zip(others, margins(others, weights, bias).tolist(), strict=True))
            wrong = sorted((w for w in others if hard[w] > -0.5), key=lambda w: (-hard[w] * in_neg[w], w))
            negatives = list(dict.fromkeys([w for w in wrong if w not in seeds][:2500] + negatives))[:8000]
        if not seeds:
            return nothing
        half = LANDMARKS // 2
        marks = seeds[:half] + negatives[: LANDMARKS - min(half, len(seeds))]
        rows = embed(marks).astype(np.float64)
        values, vectors = np.linalg.eigh(rows @ rows.T)
        root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
        x = _kernel(seeds + negatives, rows.astype(np.float32)).astype(np.float64) @ root
        y = np.r_[np.ones(len(seeds)), -np.ones(len(negatives))]
        heavy = np.r_[np.sqrt([in_pos[w] for w in seeds]), np.sqrt([max(1, in_neg[w]) for w in negatives])]
        heavy[: len(seeds)] *= len(negatives) / max(1, len(seeds)) * 0.5
        w = _machine(x, y, heavy / heavy.mean(), 1.0)
        weights, bias = rows.T @ (root @ w[:-1]), float(w[-1])
    model = Model(weights, bias, np.zeros(FEATURES + 1))
    known: dict[str, float] = {}
    rows = np.concatenate([model.features(pos, known), model.features(neg, known)])
    model.logistic = _logistic(rows, np.r_[np.ones(p), np.zeros(n)])
    return model


def learn(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", folds: int = 3, held: int = 1) -> Model:
    """A model from the labelled rows outside the held fold: at most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` of them, chosen by a hash of the key."""
    known = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).where(F.col("label").isin(0, 1) & (fold(F.col(key), folds) != held)).distinct()
    texts: dict[int, list[str]] = {}
    for value, most in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)):
        chosen = known.where(F.col("label") == value).orderBy(F.xxhash64("key"), "key").limit(most).select("key")
        rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
        found = rows.join(F.broadcast(chosen), "key").select("text").collect()
        texts[value] = [r["text"] for r in found]
    return fit(texts[1], texts[0])


def toxicity(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id", threshold: float = 0.7, folds: int = 3, held: int = 1) -> DataFrame:
    """``(key, held_out, score, predicted)`` for every row, from its whole text alone.

    Null and empty texts get the score of a text without words. Repeated rows each give a row; an
    empty table gives none; other columns are ignored. Nothing is shuffled.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for part in text_chunks(batches, "text", 4 << 20):
            texts = [words_of(t) if t else [] for t in part.column("text").to_pylist()]
            if len(known) > 500_000:
                known.clear()
            scores = model.score(model.features(texts, known))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("held_out"), pa.array(scores)], ["key", "held_out", "score"])

    rows = df.select(df[key].alias("key"), (fold(df[key], folds) == held).alias("held_out"), df[text].alias("text"))
    scored = rows.mapInArrow(run, f"key {kind}, held_out boolean, score double")
    return scored.select(F.col("key").alias(key), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
