"""The block index as a log: a batch appends what it changes, reads merge, and short segments are merged in turn.

A segment holds blocks and the keys of files whose blocks in older segments no longer count. A numbered pointer lists the
segments, oldest first, with their sizes; it appears by one rename, so readers find all of a batch or nothing of it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.index import model_gate
from corpusloom.schemas import INDEX
from corpusloom.sources.index_store import point_to, pointed, remove_old

KEYS = ["repo_id", "filepath"]
GONE = "repo_id string, filepath string"
#: Segments of like size that are merged: a row is written again once for each growth by about this factor.
FAN = 4


@dataclass(frozen=True)
class Segment:
    name: str
    rows: int  # blocks and keys

    def __str__(self) -> str:
        return f"{self.name} {self.rows}"


def segments(spark: SparkSession, path: str) -> list[Segment]:
    """Segments that count now, oldest first."""
    return [Segment(line.split()[0], int(line.split()[1])) for line in pointed(spark, path)]


def _merged(spark: SparkSession, path: str, parts: list[Segment]) -> DataFrame:
    """Blocks that count after some segments in a row."""
    if not parts:
        return spark.createDataFrame([], INDEX)
    read = lambda kind, schema: reduce(
        DataFrame.unionByName,
        [spark.read.schema(schema).parquet(f"{path}/{s.name}/{kind}").withColumn("_at", F.lit(n)) for n, s in enumerate(parts)],
    )
    blocks = read("blocks", INDEX)
    if len(parts) == 1:
        return blocks.drop("_at")
    gone = read("gone", GONE).groupBy(*KEYS).agg(F.max("_at").alias("_gone"))
    same = [blocks[k].eqNullSafe(gone[k]) for k in KEYS]
    return blocks.join(gone, [*same, blocks["_at"] < gone["_gone"]], "left_anti").drop("_at")


def load_log(spark: SparkSession, path: str, model: str) -> DataFrame:
    """The index when every row carries the model, else no rows."""
    return model_gate(_merged(spark, path, segments(spark, path)), model)


def _write(spark: SparkSession, path: str, blocks: DataFrame, gone: DataFrame) -> Segment:
    name = f"segment-{uuid.uuid4().hex}"
    blocks.select(*INDEX.names).write.parquet(f"{path}/{name}/blocks")
    gone.select(*KEYS).distinct().write.parquet(f"{path}/{name}/gone")
    sizes = [spark.read.parquet(f"{path}/{name}/{kind}").count() for kind in ("blocks", "gone")]
    return Segment(name, sum(sizes))


def append_segment(spark: SparkSession, path: str, blocks: DataFrame, gone: DataFrame, anew: bool = False, keep: int = 3) -> Segment:
    """Add blocks and take back those that older segments have of the files ``gone``; with ``anew`` older segments no
    longer count. What is written follows the batch: see ``compact``."""
    new = _write(spark, path, blocks, gone)
    point_to(spark, path, [str(s) for s in ([] if anew else segments(spark, path)) + [new]])
    compact(spark, path, keep)
    return new


def compact(spark: SparkSession, path: str, keep: int = 3) -> None:
    """Merge the newest segments while FAN of them are of like size, and remove what the ``keep`` newest pointers do not
    list. A row moves to a segment of FAN times the size each time, so it is written about log(rows) times in all."""
    parts = segments(spark, path)
    while True:
        tail = 1
        while tail < len(parts) and parts[-tail - 1].rows <= FAN * max(1, max(s.rows for s in parts[-tail:])):
            tail += 1
        if tail < FAN:
            break
        older, merged = parts[:-tail], parts[-tail:]
        gone = reduce(DataFrame.unionByName, [spark.read.schema(GONE).parquet(f"{path}/{s.name}/gone") for s in merged])
        one = _write(spark, path, _merged(spark, path, merged), gone if older else gone.limit(0))
        parts = [*older, one]
        point_to(spark, path, [str(s) for s in parts])
    remove_old(spark, path, keep)
