"""Document fingerprints: the k least shingle hashes of a text (a bottom-k sketch).

Sketches of parts merge to the sketch of the whole. Two of them estimate how much the shingle sets resemble each other,
how far one holds the other, and one how many distinct shingles there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.registry import query, small_batches, table, texts
from corpusloom.llm.words import mix, parts_of, run_starts, runs_of_words, words_of
from corpusloom.session import scratch_path

#: Bytes of text that one task pairs with their neighbours at a time.
GROUP_BYTES = 8 << 20


def sketches(column: pa.Array, k: int, shingle: int) -> list[np.ndarray]:
    """The k least distinct hashes of each text's runs of ``shingle`` words, ascending.

    A text with fewer words has one shingle, all its words; one without words has an empty sketch.
    """
    return [x for _, part in parts_of(column) for x in _sketches(part, k, shingle)]


def _sketches(column: pa.Array, k: int, shingle: int) -> list[np.ndarray]:
    words = words_of(column)
    counts = np.diff(words.first)
    starts = run_starts(words.first, shingle)
    hashes = runs_of_words(words.hash, shingle)[starts]
    of = np.repeat(np.arange(len(counts)), np.maximum(counts - shingle + 1, 0))
    few = np.flatnonzero((counts > 0) & (counts < shingle))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for j in range(shingle - 1):
            has = counts[few] > j
            short[has] = mix(short[has] * np.uint64(31) + words.hash[words.first[few[has]] + j])
        hashes, of = np.concatenate([hashes, short]), np.concatenate([of, few])
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    hashes, of = hashes[new], of[new]
    edges = np.searchsorted(of, np.arange(len(counts) + 1))
    return [hashes[a : min(b, a + k)] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def merged(parts: list[np.ndarray], k: int) -> np.ndarray:
    """Sketch of the union of the sets that ``parts`` were made of."""
    return np.unique(np.concatenate(parts))[:k] if parts else np.empty(0, np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Estimated size of the intersection of the shingle sets over that of the union; 1 for two empty ones."""
    both = merged([a, b], k)
    if not len(both):
        return 1.0
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True).sum() / len(both))


def distinct(sketch: np.ndarray, k: int) -> float:
    """Estimated number of distinct shingles; exact below k."""
    if len(sketch) < k:
        return float(len(sketch))
    return (k - 1) * 2.0**64 / (float(sketch[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Estimated share of a's shingles that b has too; 1 if a has none."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merged([a, b], k), k) / distinct(a, k))


def fingerprint_documents(
    docs: DataFrame, k: int = 128, shingle: int = 5, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, sketch, n_shingles) of every row: the sketch as little-endian 64-bit hashes, the estimated count.

    Null and empty texts have an empty sketch and no shingles. Repeated rows and null ids give a row each, an empty table
    none. Other columns are ignored. No shuffle.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = sketches(batch.column("text"), k, shingle)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array([x.astype("<u8").tobytes() for x in found], pa.binary()),
                    pa.array([distinct(x, k) for x in found], pa.float64()),
                ],
                names=["doc_id", "sketch", "n_shingles"],
            )

    return texts(docs, doc_id, text).mapInArrow(run, "doc_id long, sketch binary, n_shingles double")


def merge_sketches(parts: DataFrame, key: str, k: int = 128) -> DataFrame:
    """(key, sketch) of all parts of each key; ``parts`` has the columns ``key`` (text) and ``sketch``.

    Tasks merge their own rows first, so a hot key is sent as one sketch for each task. A null key is a key of its own;
    a null sketch is an empty one.
    """

    def fold(batches):
        held: dict = {}
        for batch in batches:
            for name, sketch in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = [np.frombuffer(sketch or b"", "<u8")]
                held[name] = merged([held[name], *parts] if name in held else parts, k)
        yield pa.record_batch(
            [pa.array(list(held), pa.string()), pa.array([x.astype("<u8").tobytes() for x in held.values()], pa.binary())],
            names=["key", "sketch"],
        )

    rows = parts.select(F.col(key).cast("string").alias("key"), F.col("sketch").alias("sketch"))
    once = rows.mapInArrow(fold, "key string, sketch binary")
    return once.repartition("key").mapInArrow(fold, "key string, sketch binary")


def _places(rows: DataFrame) -> DataFrame:
    """Adds the order by descending doc_id, null ids last; rows of one id by a hash of their text."""
    return rows.withColumn(
        "place", F.bitwise_not(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    ).withColumn("tie", F.xxhash64("text"))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """Rows (doc_id, text, place, tie, bucket, guest) in buckets that are ranges of the descending order of ids.

    Every bucket ends with a guest: a copy of the first row of the bucket after it, of the first bucket for the last. So
    each row finds its next document in its own bucket. Buckets come from percentiles of the ids, one for each
    GROUP_BYTES of text; their first rows, one for each bucket, are written to the shared folder.
    """
    rows = texts(docs, doc_id, text)
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(4, -(-size // GROUP_BYTES)))
    placed = _places(rows)
    cuts = placed.select("place").agg(
        F.percentile_approx("place", [i / buckets for i in range(1, buckets)], 10_000)
    ).first()[0]
    edges = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("long")
    def bucket_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, place.to_numpy(), "left"))

    rows = placed.withColumn("bucket", bucket_of("place"))
    firsts = (
        placed.select("place", "tie")
        .withColumn("bucket", bucket_of("place"))
        .groupBy("bucket")
        .agg(F.min(F.struct("place", "tie")).alias("first"))
        .select("bucket", "first.place", "first.tie")
        .collect()
    )  # one row for each bucket
    firsts.sort(key=lambda r: r.bucket)
    hosts = [(firsts[n - 1].bucket, r.place, r.tie) for n, r in enumerate(firsts)]
    guests = (
        placed.join(F.broadcast(spark.createDataFrame(hosts, "bucket long, place long, tie long")), ["place", "tie"])
        .groupBy("bucket", "place", "tie", "doc_id")
        .agg(F.first("text").alias("text"))
    )
    path = scratch_path(spark, "next-documents")
    guests.write.parquet(path)
    columns = ["doc_id", "text", "place", "tie", "bucket"]
    both = rows.select(*columns, F.lit(0).alias("guest")).unionByName(
        spark.read.parquet(path).select(*columns, F.lit(1).alias("guest"))
    )
    return both, len(firsts)


def compare_with_edited(
    docs: DataFrame, k: int = 128, shingle: int = 5, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """For each row its fingerprint and that of its edited text, and how alike they and the next document's are.

    Columns: doc_id, n_chars, edited (the text), fingerprint, edited_fingerprint (hexadecimal), near_edited, near_next,
    inside_next (containment of the shingles in the next document's), n_shingles. The next document follows in descending
    doc_id, the first follows the last, so a table of one row is its own next. The edited text has the last
    floor(n_chars / 2) characters replaced by the first as many of the next text, or by all of it if it is shorter.

    Null ids come last; rows of one id are ordered by a hash of their text. Null and empty texts have an empty
    fingerprint, alike (1) to another empty one. An empty table gives no rows. Other columns are ignored.
    """
    paired, buckets = with_next(docs, doc_id, text)
    schema = (
        "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, "
        "near_next double, inside_next double, n_shingles double"
    )

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("guest", "ascending"), ("place", "ascending"), ("tie", "ascending")])
        values = rows.column("text").to_pylist()
        own, after = values[:-1], values[1:]
        edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(own, after, strict=True)]
        plain = sketches(pa.array(values, pa.large_string()), k, shingle)
        changed = sketches(pa.array(edited, pa.large_string()), k, shingle)
        text_of = lambda x: x.astype(">u8").tobytes().hex()
        return pa.table(
            [
                rows.column("doc_id").slice(0, len(own)),
                pa.array(map(len, own), pa.int64()),
                pa.array(edited, pa.string()),
                pa.array(map(text_of, plain[:-1]), pa.string()),
                pa.array(map(text_of, changed), pa.string()),
                pa.array([resemblance(a, b, k) for a, b in zip(plain, changed)], pa.float64()),
                pa.array([resemblance(a, b, k) for a, b in zip(plain, plain[1:])], pa.float64()),
                pa.array([containment(a, b, k) for a, b in zip(plain, plain[1:])], pa.float64()),
                pa.array([distinct(a, k) for a in plain[:-1]], pa.float64()),
            ],
            names=[c.split()[0] for c in schema.split(", ")],
        )

    return paired.repartition(max(1, buckets), "bucket").groupBy("bucket").applyInArrow(run, schema)


@query()
def op8_fingerprints(spark, sf_dir):
    return compare_with_edited(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
        "inside_next",
        "n_shingles",
    )
