"""From documents to packed training sequences: toxic texts go, one text of each near-duplicate class stays, repeated
passages go, and what is left is packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.near_duplicates import near_duplicates
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.registry import table
from corpusloom.llm.substrings import drop_repeated_passages
from corpusloom.llm.toxicity import fit, learning_labels, without_toxic
from corpusloom.session import scratch_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the model, fitted on the labelled ones among them, does not reject. Null texts count as empty
    and stay."""
    return without_toxic(docs, fit(docs, learning_labels(table(spark, sf_dir, "labels"))))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id in each class of near duplicates, unchanged."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = near_duplicates(docs, carry=rest).where("kept")
    text = F.when(~F.col("rest.no_text"), F.col("text")).alias("text")
    return kept.select("doc_id", text, *[F.col("rest")[f"own_{c}"].alias(c) for c in rest]).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; one that repeats a passage of 20 words or more of an earlier one keeps its other words, joined by
    one space, and ``n_chars`` follows. Texts that lose nothing are unchanged."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = drop_repeated_passages(docs, carry=rest)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept").cast("string")).when(~F.col("rest.no_text"), F.col("text"))
    size = F.when(changed, F.length(F.col("kept").cast("string"))).otherwise(F.col("rest.own_n_chars"))
    columns = {c: F.col("rest")[f"own_{c}"] for c in rest} | {"doc_id": F.col("doc_id"), "text": text, "n_chars": size.cast("long")}
    return found.select(*[columns[c].alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    packed = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicate),
    ("substrings", substrings),
    ("packing", packing),
]

#: SQL can't express a trained classifier or a tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
