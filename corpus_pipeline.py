"""A corpus-cleaning pipeline of five stages over ``documents``.

Language identification, SimHash near-dedup, repeated passages, benchmark decontamination, and BPE
encoding. Every stage but the last gives rows of documents; what a stage drops or cuts is gone for
those after it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.common import cut, measured
from stopwise.llm.decontaminate import contamination
from stopwise.llm.language import fold, predict, prototypes
from stopwise.llm.lexicon import encode_corpus
from stopwise.llm.passages import remove_passages
from stopwise.llm.simhash import simhash_groups

BYTE_BPE = "byte_bpe_50k.json"
#: Texts whose best cosine with a learned language is less are in none of them.
LEAST_COSINE = 0.05


def held(docs: DataFrame) -> DataFrame:
    """``(own, doc_id, text)``: the whole row is kept in one struct, so that no column's name can clash with an operator's."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("own"), docs["doc_id"], docs["text"])


def freed(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("own")[c].alias(c) for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; where ``lang`` is null it becomes the one told.

    Learned from the labelled documents outside a fifth of the ids. Those rejected are null and
    empty texts, texts without a letter, and texts that are like no learned language: their best
    cosine is below ``LEAST_COSINE``. If no document has a language, none is rejected for it. Very
    long texts are read whole; repeated rows stay; an empty table gives none; other columns stay
    as they are.
    """
    learned = prototypes(docs.where(fold(docs["doc_id"], 5) != 0))
    told = predict(held(docs), learned, keep=["own"])
    if learned:
        told = told.where((F.col("lang_pred") != "und") & (F.col("cosine") >= LEAST_COSINE))
    else:
        told = told.where(F.col("own.text").rlike(r"\p{L}"))
    said = F.coalesce(F.col("own.lang"), F.when(F.col("lang_pred") != "und", F.col("lang_pred")))
    return told.select(*[said.alias(c) if c == "lang" else F.col("own")[c].alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the row with the smallest id; null ids come last, and ties go by a hash of the row.

    A row is named by its id and a hash of all its columns, so that unlike texts that share an id
    are told apart; of rows that repeat as a whole one stays. Null, empty and wordless texts are
    one group. Very long texts count whole; an empty table gives none.
    """
    plain = [c for c in docs.columns if not docs.schema[c].dataType.simpleString().startswith("map")]
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64(*[F.col("own")[c] for c in plain]).alias("row"))
    rows = held(docs).withColumn("name", name)
    groups = cut(simhash_groups(rows.select("name", "text"), key="name"))
    later = measured(cut(groups.where("name <> component_id").select("name").distinct()))
    twice = measured(cut(groups.groupBy("name").count().where("count > 1").select("name")))
    first = rows.join(later, "name", "left_anti")
    one = first.join(twice, "name", "left_semi").dropDuplicates(["name"])
    return freed(first.join(twice, "name", "left_anti").unionByName(one), docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words that an earlier one has; those left without words go.

    n_chars is counted anew. Null and empty texts have no passages and stay; unlike texts that
    share an id are told apart; rows that repeat as a whole count as one text and stay. Very long
    texts are read whole; an empty table gives none; other columns stay as they are.
    """
    out = remove_passages(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in benchmark items.

    Null and empty texts have no words and stay; repeated rows and long texts each get their own
    decision; empty tables work; columns stay as they are, whatever their names.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return freed(contamination(held(docs), items, keep=["own"]).where(~F.col("contaminated")), docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded text, for every row; null counts as empty."""
    return encode_corpus(docs, public_tokenizers.path(BYTE_BPE))


STAGES = [
    ("language", language),
    ("simhash", near_copies),
    ("passages", passages),
    ("decontamination", decontamination),
    ("bpe", encoding),
]
#: SQL expresses neither the vectors, the fingerprints nor the token merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
