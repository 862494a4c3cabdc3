"""Registered queries of this subpackage and their SQL texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its own name, with its SQL text when there is one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(doc_id, text) of a table with any other columns; a null text becomes an empty one.

    With ``carry``, a column ``rest`` holds those columns, each named ``own_`` and its name, and, as ``no_text``, whether the
    text is null.
    """
    own = [F.col(f"`{c}`").alias(f"own_{c}") for c in carry or []]
    rest = [] if carry is None else [F.struct(*own, F.col(text).isNull().alias("no_text")).alias("rest")]
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *rest
    )


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of a batch that goes to Python, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
