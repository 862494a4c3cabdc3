"""Incremental maintenance of the block index."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: file states and skip reasons
NEW, CHANGED, UNMODIFIED, DELETED = "new", "changed", "unmodified", "deleted"


def index_keys(index: DataFrame, keys=("filepath",)) -> DataFrame:
    """One stored checksum per file; partial aggregation shrinks files with many blocks before the shuffle."""
    return index.groupBy(*keys).agg(F.max("file_checksum").alias("stored_checksum"))


def detect_changes(files: DataFrame, index: DataFrame, keys=("filepath",), deleted: bool = False) -> DataFrame:
    """Status of each file against the index; D6 with ``deleted``: also files only the index knows."""
    known = index_keys(index, keys)
    joined = files.join(known, list(keys), "full_outer" if deleted else "left")
    current, stored = F.col("file_checksum"), F.col("stored_checksum")
    status = (
        F.when(current.isNull(), DELETED)
        .when(stored.isNull(), NEW)
        .when(current != stored, CHANGED)
        .otherwise(UNMODIFIED)
    )
    return joined.withColumn("status", status)


def checksum_paths(index: DataFrame) -> DataFrame:
    """One path per checksum, the smallest."""
    return index.groupBy("file_checksum").agg(F.min("filepath").alias("filepath"))


def drop_outdated(index: DataFrame, stale: DataFrame, by=("file_checksum",)) -> DataFrame:
    """D3: rows of the index whose key is not stale."""
    return index.join(stale.select(*by).distinct(), list(by), "left_anti")


def append(index: DataFrame, new: DataFrame) -> DataFrame:
    """Union; columns missing on either side become NULL."""
    return index.unionByName(new, allowMissingColumns=True)


def drop_deleted(index: DataFrame, files: DataFrame, keys=("filepath",)) -> DataFrame:
    """Rows of the index whose file still exists."""
    return index.join(files.select(*keys).distinct(), list(keys), "left_semi")


def skip_reason(changes: DataFrame) -> DataFrame:
    """Why a file was or was not cut, tested in order.

    Needs ``status``, ``handler``, ``error`` (NULL when none) and ``n_blocks``.
    """
    reason = (
        F.when(F.col("status") == UNMODIFIED, "unmodified")
        .when(F.col("handler").isNull(), "no_parser")
        .when(F.col("error").isNotNull(), "error")
        .when(F.coalesce("n_blocks", F.lit(0)) == 0, "no_blocks")
        .otherwise("extracted")
    )
    return changes.withColumn("reason", reason)


def reason_counts(reasons: DataFrame) -> DataFrame:
    return reasons.groupBy("reason").agg(
        F.count("*").alias("n_files"), F.sum(F.coalesce("n_blocks", F.lit(0))).cast("long").alias("n_blocks")
    )


def model_gate(index: DataFrame, model: str) -> DataFrame:
    """The index as it is when every row carries the model, else no rows (a rebuild is due)."""
    if "embedding_model" not in index.columns:
        return index.limit(0)
    foreign = index.filter(~F.col("embedding_model").eqNullSafe(model)).limit(1)
    flag = foreign.agg((F.count("*") == 0).alias("_usable"))
    usable = flag.filter("_usable").select(F.lit(1).alias("_one"))
    # one row at most on the right, so the broadcast has a fixed size
    return (
        index.withColumn("_one", F.lit(1)).join(F.broadcast(usable), "_one", "left_semi").drop("_one")
    )
