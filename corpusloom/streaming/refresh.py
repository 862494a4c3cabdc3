"""Index refresh driven by a stream of files."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.plans.refresh import KEYS, changed_rows
from corpusloom.session import scratch_path
from corpusloom.sources.index_log import append_segment, load_log, segments


def latest_per_file(files: DataFrame, modified: str = "modified") -> DataFrame:
    """One row per file, the newest, and of several at one time that of the greatest checksum; texts stay out of the
    aggregation."""
    marked = files.withColumn("_sum", F.coalesce(F.md5("content"), F.lit("")))
    newest = marked.groupBy(*KEYS).agg(F.max(F.struct(modified, "_sum")).alias("_newest"))
    newest = newest.select(*KEYS, F.col("_newest")[modified].alias(modified), F.col("_newest._sum").alias("_sum"))
    return marked.join(newest, [*KEYS, modified, "_sum"], "left_semi").dropDuplicates([*KEYS]).drop("_sum")


def take_in(batch: DataFrame, path: str, model_name: str, model=None, rules=()) -> None:
    """Append to the log at ``path`` what a batch of files(repo_id, filepath, content, modified) changes.

    What is written follows the batch, not the index. A row without content says that its file is gone. A log of another
    model no longer counts. A batch that is taken in again finds its files unmodified and appends nothing.
    """
    spark = batch.sparkSession
    latest = latest_per_file(batch)
    stored = load_log(spark, path, model_name)
    foreign = any(s.rows for s in segments(spark, path)) and stored.isEmpty()
    fresh, stale = changed_rows(latest.where("content is not null"), stored, model_name, model, rules)
    removed = latest.where("content is null").select(*KEYS).join(stored.select(*KEYS).distinct(), list(KEYS), "left_semi")
    path_of = [scratch_path(spark, name) for name in ("fresh-blocks", "gone-files")]
    fresh.write.parquet(path_of[0])
    stale.unionByName(removed).write.parquet(path_of[1])
    blocks, gone = (spark.read.parquet(p) for p in path_of)
    if foreign or not (blocks.isEmpty() and gone.isEmpty()):
        append_segment(spark, path, blocks, gone, anew=foreign)


def stream_refresh_index(
    files: DataFrame, path: str, model_name: str, checkpoint: str, model=None, rules=()
) -> StreamingQuery:
    """Take in what is new since the last run, then stop, see ``take_in``; ``load_log`` reads the index."""

    def take(batch: DataFrame, _: int) -> None:
        take_in(batch, path, model_name, model, rules)

    return (
        files.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
