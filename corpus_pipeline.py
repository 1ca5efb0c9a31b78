"""A corpus pipeline: quality rules, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before kept and returns a
DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import byte_bpe, jaccard_join, pii, quality_rules, source_mix
from barlake.llm.common import shared_folder
from barlake.llm.queries import VOCABULARY

#: SQL cannot express the trained classifier nor the merge recursion; tests use brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those that fail the rules (null, empty and short texts do) or the model. Repeated rows are judged alike."""
    model = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.judge(docs, model).where("kept").select(*docs.columns)


def _free(name: str, docs: DataFrame) -> str:
    """The name, or a longer one that docs has no column of."""
    while name in docs.columns:
        name += "_"
    return name


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one of the least doc_id (null last), of several the one of the least row hash.

    Rows are told apart by a hash of all their columns, so different texts under one doc_id, and rows of null doc_id,
    are judged like others; equal rows count once. Texts without a word have no class and stay.
    """
    key = _free("kept_key", docs)
    found = jaccard_join.join(docs).where("text_key is not null")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))["row_key"]
    kept = found.groupBy("class_key").agg(first.alias(key)).select(key)
    once = docs.withColumn(key, F.xxhash64(*docs.columns)).join(kept, key).dropDuplicates([key]).select(*docs.columns)
    return once.unionByName(docs.where(source_mix.word_count() == 0))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans give way to their kind; n_chars follows the new text. Null texts stay null; every row stays."""
    found = pii.detect(docs)
    text = F.col("redacted")
    changed = found.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else changed


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Equal rows are told apart by nothing, so together they stand as often as the mix takes them all."""
    key, copies, copy = (_free(n, docs) for n in ("row_key", "copies", "copy"))
    taken = source_mix.mix(docs).groupBy(F.col("row_key").alias(key)).agg(F.sum("copies").cast("int").alias(copies)).where(F.col(copies) > 0)
    once = docs.withColumn(key, F.xxhash64(*docs.columns)).dropDuplicates([key])
    return once.join(taken, key).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, checked by decoding them; null and empty texts have none."""
    coded = byte_bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    intact = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", intact.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
