"""Token counts through a cache of digests.

Every text is named by the SHA-256 of its normalised content, every tokenizer by the SHA-256 of its file. Counts already
stored for both digests are joined; only one copy of each text that is missing is encoded, and its count is appended.

Normalisation must not change counts, so it is only this: a null text is an empty one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.registry import query, small_batches, table, texts
from corpusloom.llm.vocabularies import LibraryEncoder, built, read_vocabulary
from corpusloom.session import scratch_path

CACHE = "tokenizer string, digest string, n_tokens long"


def stored_counts(spark, cache_dir: str, version: str) -> DataFrame:
    """(digest, n_tokens) the cache holds for a tokenizer; a digest appended twice counts once."""
    rows = spark.read.schema(CACHE).parquet(cache_dir).where(F.col("tokenizer") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame, vocabulary: str, cache_dir: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``cache_dir`` is a Parquet folder that jobs share; it is made when missing, and grows by the distinct texts that no
    earlier job has counted. Appending is Spark's own committed write: after a lost executor or driver the cache holds
    either all counts of a job or none. Two jobs that append the same digest do no harm.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows, and null or repeated ids, give a row each. An empty
    table gives no rows. Other columns of ``docs`` are ignored, whatever their names.

    A copied text, however often it occurs, leaves each task once (the aggregation starts before the shuffle).
    """
    spark = docs.sparkSession
    small_batches(spark)
    content, kind, version = read_vocabulary(vocabulary)
    shipped = spark.sparkContext.broadcast(content)
    spark.createDataFrame([], CACHE).write.mode("ignore").parquet(cache_dir)
    rows = texts(docs, doc_id, text).withColumn("digest", F.sha2("text", 256))
    misses = (
        rows.groupBy("digest")
        .agg(F.first("text").alias("text"))
        .join(stored_counts(spark, cache_dir, version), "digest", "left_anti")
    )

    def encode(batches):
        encoder = built(version, lambda: LibraryEncoder(shipped.value, kind))
        for batch in batches:
            counts = [len(encoder.ids(t.as_py())) for t in batch.column("text")]
            yield pa.record_batch(
                [pa.array([version] * len(counts), pa.string()), batch.column("digest"), pa.array(counts, pa.int64())],
                names=["tokenizer", "digest", "n_tokens"],
            )

    misses.select("digest", "text").mapInArrow(encode, CACHE).write.mode("append").parquet(cache_dir)
    counted = stored_counts(spark, cache_dir, version)
    return (
        rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
        .join(counted, "digest", "left")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


@query()
def op6_token_counts(spark, sf_dir):
    """Counts of all documents; the cache is a fresh one, so that every distinct text is encoded in this query."""
    import public_tokenizers

    return count_tokens(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        scratch_path(spark, "token-counts"),
    )
