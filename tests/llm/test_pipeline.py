"""The stages of the pipeline on odd rows, and the whole of it against a brute-force version."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline as pipeline  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string, cosine string, row string, ids string, n_hit string, own string"
CLASH = ("clash",) * 7


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "web", len(t or ""), *CLASH) for i, t, lang in rows], SCHEMA)


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    words = prose(random.Random(1), 20, "uvwxyz")
    spark.createDataFrame([(1, words), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, words


def odd_rows(rng, item):
    text = prose(rng, 90)
    return [
        (1, text, "en"), (1, prose(rng, 80), "en"), (2, text, "en"), (None, text, None), (None, prose(rng, 70), None), (3, None, "en"), (4, "", None),
        (5, "漢字 😀 한국어 かな　カナ", "zh"), (6, "12 !! 34", "en"), (7, f"{prose(rng, 30)} {item} {prose(rng, 30)}", "en"), (8, prose(rng, 20_000), "en"),
        (9, prose(rng, 75), None), (9, prose(rng, 65), "en"),
    ]


def test_stages_keep_columns_and_rows(spark, folder):
    path, item = folder
    rows = odd_rows(random.Random(2), item)
    docs = table(spark, rows + rows[8:9] + rows[7:8])
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        got = out.collect()
        assert all(r["score"] == r["row"] == r["n_hit"] == r["own"] == "clash" for r in got), name
        texts = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in got))
        whole = sorted((i is None, i or 0, t or "") for i, t, _ in rows + rows[8:9] + rows[7:8])
        if name == "language":
            assert texts == [x for x in whole if x[2] and x[2] != rows[8][1]] and all(r["lang"] for r in got)
        if name == "simhash":  # of equal texts, empty ones too, one row stays
            assert [x[2] for x in texts].count(rows[0][1]) == 1 and {x[2] for x in texts} == {x[2] for x in whole} and len(texts) == len(rows) - 3
        if name == "passages":
            assert [x[2] for x in texts].count(rows[0][1]) == 1 and len(texts) == len(rows)
        if name == "decontamination":
            assert texts == [x for x in whole if item not in x[2]]
        assert stage(spark, docs.limit(0), path).count() == 0, name
    coded = pipeline.encoding(spark, docs, path).collect()
    assert len(coded) == len(rows) + 2


def test_unlike_texts_that_share_an_id_stay(spark, folder):
    rng = random.Random(3)
    rows = [(1, prose(rng, 40), "en") for _ in range(4)] + [(None, prose(rng, 40), "en") for _ in range(3)]
    got = pipeline.near_copies(spark, table(spark, rows + rows), folder[0]).collect()
    assert sorted(r["text"] for r in got) == sorted(t for _, t, _ in rows)


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    item, passage = prose(rng, 15, "uvwxyz"), prose(rng, 60)
    texts = [prose(rng, 100) for _ in range(12)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(20, texts[3], "en"), (21, texts[4] + ".", "en")]
    rows += [(30, f"{prose(rng, 40)} {passage} {prose(rng, 40)}", "en"), (31, f"{prose(rng, 50)} {passage} {prose(rng, 20)}", "en"), (40, f"{item} {prose(rng, 9)}", "en"), (41, "1 2 3", "en"), (42, None, "en")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # by hand: letterless and null texts go, then copies, then the later passage, then the contaminated row
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(pipeline.public_tokenizers.path(pipeline.BYTE_BPE))
    want = {i: t for i, t, _ in rows if i not in (20, 40, 41, 42)}
    want[31] = want[31].replace(passage + " ", "")
    got = {r["doc_id"]: r["n_tokens"] for r in pipeline.run(spark, str(tmp_path)).collect()}

    want = {i: len(coder.encode(t, add_special_tokens=False).ids) for i, t in want.items() if i != 21}
    assert {i: n for i, n in got.items() if i != 21} == want
