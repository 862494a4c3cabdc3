"""Source trees as file tables."""

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage

BATCH_BYTES = 64 << 20  # content handed over per Arrow batch
_ENTRY = pa.schema(
    [("dir", pa.bool_()), ("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", tz="UTC"))]
)
_ENTRY_DDL = "dir boolean, path string, length bigint, modified timestamp"


def _list_entries(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        base = base.rstrip("/")
        for batch in batches:
            for below in batch.column(0).to_pylist():
                found = system.get_file_info(fs.FileSelector(f"{base}/{below}" if below else base))
                rows = [
                    {
                        "dir": item.type == fs.FileType.Directory,
                        "path": item.path[len(base) :].lstrip("/"),
                        "length": item.size,
                        "modified": item.mtime,
                    }
                    for item in found
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=_ENTRY)

    return run


def _read_contents(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            start, held, contents = 0, 0, []
            for number, path in enumerate(batch.column(0).to_pylist()):
                with system.open_input_file(f"{base.rstrip('/')}/{path}") as file:
                    contents.append(file.read())
                held += len(contents[-1])
                if held >= BATCH_BYTES or number == batch.num_rows - 1:
                    part = batch.slice(start, len(contents))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(contents, pa.binary()), part.column(1), part.column(2)],
                        names=["path", "content", "length", "modified"],
                    )
                    start, held, contents = number + 1, 0, []

    return run


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path below the root, length, modified) of every file, hidden ones included.

    The engine's own file sources leave out names that begin with a dot or an underscore, ``__init__.py`` among them.
    Here the tasks list one level of directories at a time, so a wide tree is listed by all executors.
    """
    level = spark.createDataFrame([("",)], "path string")
    found = None
    while True:
        entries = cut_lineage(level.mapInArrow(_list_entries(root), _ENTRY_DDL))
        files = entries.filter(~F.col("dir")).drop("dir")
        found = files if found is None else found.unionByName(files)
        below = entries.filter("dir").select("path")
        if below.isEmpty():
            break
        level = below.repartition(spark.sparkContext.defaultParallelism, "path")
    if glob == "*":
        return found
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    pattern = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() else c) for c in glob)
    return found.filter(name.rlike(f"^{pattern}$"))


def scan_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """A1: (path, content, length, modified) of every file below the root; a glob keeps other files from being read."""
    listed = list_files(spark, root, glob)
    dealt = listed.select("path", "length", "modified").repartition(spark.sparkContext.defaultParallelism, "path")
    return dealt.mapInArrow(
        _read_contents(root), "path string, content binary, length bigint, modified timestamp"
    )


def announce_files(spark: SparkSession, root: str, arrivals: str, glob: str = "*") -> None:
    """Append to the folder ``arrivals`` a row (path, length, modified) for every file that is new or has changed since
    the last call. Hidden names, which the engine's own file stream leaves out, are announced like any other."""
    kind = "path string, length bigint, modified timestamp"
    spark.createDataFrame([], kind).write.mode("ignore").parquet(arrivals)
    known = spark.read.schema(kind).parquet(arrivals)
    fresh = cut_lineage(list_files(spark, root, glob).join(known, ["path", "length", "modified"], "left_anti"))
    fresh.select("path", "length", "modified").write.mode("append").parquet(arrivals)


def stream_files(spark: SparkSession, root: str, arrivals: str, max_files: int = 1) -> DataFrame:
    """A1 as a stream: files announced in ``arrivals``, read by the same reader as the batch form; ``max_files`` files of
    announcements in a batch."""
    paths = (
        spark.readStream.schema("path string, length bigint, modified timestamp")
        .option("maxFilesPerTrigger", max_files)
        .parquet(arrivals)
    )
    return paths.mapInArrow(_read_contents(root), "path string, content binary, length bigint, modified timestamp")


def as_text(files: DataFrame, repo_id: str) -> DataFrame:
    """Code files in the form the index reads: (repo_id, filepath, content, modified)."""
    return files.select(
        F.lit(repo_id).alias("repo_id"),
        F.col("path").alias("filepath"),
        F.decode(F.col("content"), "UTF-8").alias("content"),
        "modified",
    )
