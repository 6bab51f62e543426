"""Fingerprints, language vectors and toxicity margins against plain versions of their definitions."""

import itertools
import random

import numpy as np
import xxhash

from stopwise.llm import language, toxicity
from stopwise.llm.simhash import simhash_groups

SCHEMA = "doc_id long, text string, fingerprint string, component_id string"


def fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice(["One", "two", "DREI", "été", "漢字", "x"]) for _ in range(rng.choice([1, 2, 3, 40, 200]))) for _ in range(25)]
    texts = [None, "", " \n", *base, *[b + " end" for b in base], *base[:5], "A b c", "a b c", "long " * 3000]
    keys = list(range(100, 100 + len(texts)))
    rng.shuffle(keys)
    fps = [fingerprint(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(keys):
        least[find(i)] = min(k, least.get(find(i), k))
    want = {(k, f"{fps[i]:016x}", least[find(i)]) for i, k in enumerate(keys)}
    docs = spark.createDataFrame([(k, t, "clash", "clash") for k, t in zip(keys, texts, strict=True)], SCHEMA)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_groups(docs).collect()} == want


def test_language_vectors_equal_brute_force():
    t = language.Trigrams()
    table = language.symbols()
    texts = ["The cat, the CAT!", "a", "", None, "12 !?", "Über straße naïve", "漢字かな 한국어 кот", "ab " * 5000] + ["".join(random.Random(i).choice("abc де字 ") for _ in range(300)) for i in range(200)]
    got = t.bundle(texts)
    for text, row in zip(texts, got, strict=True):
        s = [0, *(int(table[ord(c)]) for c in (text or "").lower()), 0]
        counts = {}
        for a, b, c in zip(s, s[1:], s[2:]):
            if b:
                counts[a, b, c] = counts.get((a, b, c), 0) + 1
        want = np.zeros(language.DIMENSIONS)
        for (a, b, c), n in counts.items():
            want += np.rint(16 * np.sqrt(n)) * np.roll(t.letters[a], 2) * np.roll(t.letters[b], 1) * t.letters[c]
        norm = np.sqrt(want @ want)
        assert np.allclose(row, want / norm if norm else want, atol=1e-5)


def test_languages_of_other_scripts(spark):
    rng = random.Random(2)
    letters = {"el": "αβγδεζηθικλμν", "ru": "абвгдежзиклмн", "ja": "かきくけこさしすせそ", "ko": "가나다라마바사아자", "en": "etaoinshrdlu"}
    word = lambda l: "".join(rng.choice(letters[l]) for _ in range(4))
    rows = [(i, " ".join(word(l) for _ in range(12)), l) for i, l in enumerate(list(letters) * 40)]
    got = language.identify(spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string")).collect()
    held = [r for r in got if r["held_out"]]
    said = {i: l for i, _, l in rows}
    assert len(got) == 201 and held and sum(r["lang_pred"] == said[r["doc_id"]] for r in held) >= 0.9 * len(held)  # short texts of random letters
    # equal languages tie, and the first by name is told
    same = [(i, "the cat sat", l) for i, l in enumerate(["b", "a"] * 20)]
    assert {r["lang_pred"] for r in language.identify(spark.createDataFrame(same, "doc_id long, text string, lang string")).collect()} <= {"a", "b"}
    assert language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").limit(0)).count() == 0


def test_margins_equal_enumeration():
    rng = np.random.default_rng(3)
    weights, bias = rng.normal(size=toxicity.SYMBOLS**3), -0.3
    words = ["blockhead", "b-l-o-c-k", "a", "", "x1y", "漢字語句", "w" * 40]
    got = toxicity.margins(words, weights, bias)
    for word, margin in zip(words, got, strict=True):
        s = [0, *(int(x) for x in (toxicity._table[ord(c)] for c in word) if x >= 0), 0]
        total = norm = 0.0
        for i, j, k in itertools.combinations(range(len(s)), 3):
            if k - i <= toxicity.SPREAD:
                w = toxicity.DECAY ** (k - i + 1)
                total += w * weights[(s[i] * toxicity.SYMBOLS + s[j]) * toxicity.SYMBOLS + s[k]]
                norm += w * w
        assert np.isclose(margin, total / np.sqrt(max(norm, 1e-12)) + bias)
