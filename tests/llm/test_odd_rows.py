"""Empty tables, repeated rows, clashing columns, and texts of several megabytes."""

import hashlib
import random

import pytest

from stopwise.llm import licences, passages
from stopwise.llm.lexicon import encode_corpus

P = pytest.importorskip("public_tokenizers")
LICENCE_COLUMNS = ["n_sentences", "sentence_ids", "rules", "licences"]


def test_licences_of_odd_rows(spark):
    mit = " ".join(licences.SENTENCES[1:4])
    long = " ".join(f"Sentence {i} says nothing of note." for i in range(60_000))
    rows = [(1, mit, "x", 1), (1, mit, "x", 1), (None, mit, "y", 2), (2, None, "x", 3), (3, "", "x", 4), (4, f"{long} {mit} {long}", "x", 5), (5, " \n\t ", "x", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rules string, matched int").repartition(3)
    got = licences.licence_scan(df)
    assert got.columns == ["doc_id", *LICENCE_COLUMNS]
    held = sorted((tuple(r) for r in got.collect()), key=str)
    assert len(held) == len(rows)
    said = {r[0]: r[1:] for r in held}
    assert said[1] == said[None] and said[1][2:] == ("mit-text", "MIT") and [r[0] for r in held].count(1) == 2
    assert said[2] == said[3] == said[5] == (0, "", "", "")
    assert said[4][0] == 120_000 + said[1][0] and said[4][1:] == said[1][1:]
    assert licences.licence_scan(df.limit(0)).count() == 0


def test_a_long_text_and_its_copied_part(spark):
    """A text of some megabytes, a passage of another row in its middle, and its own copy."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(5000)]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    part = said(70)
    long = f"{said(250_000)} {part} {said(250_000)}"
    assert len(long) > 3_000_000
    df = spark.createDataFrame([(1, part), (2, long), (3, long), (4, said(400))], "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r for r in passages.repeated_passages(df).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1]["n_words"], got[1]["removed_words"]) == (70, 0)
    assert got[2]["n_words"] == got[3]["n_words"] == 500_070 and got[3]["removed_words"] == 500_070 and got[2]["removed_words"] == 70
    kept = {r["doc_id"]: r["text"] for r in passages.remove_passages(df).collect()}
    assert set(kept) == {1, 2, 4} and len(kept[2].split()) == 500_000


def test_tokens_of_a_long_text(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    rng = random.Random(9)
    long = " ".join("".join(rng.choice("abcdeé漢 \n") for _ in range(12)) for _ in range(250_000))
    library = Tokenizer.from_file(path)
    ids = library.encode(long, add_special_tokens=False).ids
    row = encode_corpus(spark.createDataFrame([(1, long)], "doc_id long, text string"), path).first()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert row["n_tokens"] == len(ids) and row["ids_sha256"] == sha(",".join(map(str, ids))) and row["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))
