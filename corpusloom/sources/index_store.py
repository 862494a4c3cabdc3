"""The block index on disk: version folders and numbered pointers, of which the newest counts."""

import logging
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators.index import model_gate
from corpusloom.schemas import INDEX

logger = logging.getLogger(__name__)
POINTER = "current"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Numbers and names of the pointers, newest first."""
    fs, new_path = _file_system(spark, path)
    if not fs.exists(new_path(path)):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(new_path(path))]
    return sorted(((int(n.split("-")[1]), n) for n in names if n.startswith(f"{POINTER}-")), reverse=True)


def _read_pointer(spark: SparkSession, path: str, name: str) -> list[str]:
    return [row["value"] for row in spark.read.text(f"{path}/{name}").collect()]  # a line for each folder


def pointed(spark: SparkSession, path: str) -> list[str]:
    """Lines of the newest pointer; none when nothing was stored."""
    pointers = _pointers(spark, path)
    return _read_pointer(spark, path, pointers[0][1]) if pointers else []


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the current version, that of the pointer with the highest number; None when nothing was stored."""
    lines = pointed(spark, path)
    return f"{path}/{lines[0]}" if lines else None


def store_index(index: DataFrame, path: str, partition_by: tuple[str, ...] = (), keep: int = 3) -> str:
    """Write a new version, then a pointer to it.

    Pointers are numbered and never replaced: a new one appears by a single rename, and the highest number wins. So a
    reader always finds a complete version, and a job that dies before the rename leaves the old one current. Of two
    writers with the same number one fails. The ``keep`` newest versions stay for readers that hold them; older
    ones are removed with their pointers.
    """
    spark = index.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    writer = index.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/{version}")
    point_to(spark, path, [version])
    remove_old(spark, path, keep)
    return f"{path}/{version}"


def point_to(spark: SparkSession, path: str, lines: list[str]) -> None:
    """A new pointer with these lines; the first word of each names a folder."""
    fs, new_path = _file_system(spark, path)
    draft = new_path(f"{path}/.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.writeBytes("\n".join(lines))
    out.close()
    pointers = _pointers(spark, path)
    number = pointers[0][0] + 1 if pointers else 1
    if not fs.rename(draft, new_path(f"{path}/{POINTER}-{number:012d}")):
        raise RuntimeError(f"another writer has stored version {number} of {path}")


def remove_old(spark: SparkSession, path: str, keep: int) -> None:
    """Remove all but the ``keep`` newest pointers, and the folders that none of these lists."""
    fs, new_path = _file_system(spark, path)
    pointers = [(name, {line.split()[0] for line in _read_pointer(spark, path, name)}) for _, name in _pointers(spark, path)]
    needed = set().union(*(folders for _, folders in pointers[: max(1, keep)]))
    for name, folders in pointers[max(1, keep) :]:
        for folder in folders - needed:
            fs.delete(new_path(f"{path}/{folder}"), True)
        fs.delete(new_path(f"{path}/{name}"), False)


def load_index(spark: SparkSession, path: str, model: str, schema=INDEX) -> DataFrame:
    """The current version when every row carries the model; no rows when it is missing, unreadable, or
    written under another model."""
    version = current_version(spark, path)
    if version is None:
        return spark.createDataFrame([], schema)
    try:
        stored = spark.read.parquet(version)
    except AnalysisException as problem:
        logger.error("stored index cannot be read, rebuild it: %s", problem)
        return spark.createDataFrame([], schema)
    return model_gate(stored, model)
