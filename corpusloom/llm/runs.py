"""Runs: parts of a table of texts that a task handles whole, and questions that runs ask of all others.

Texts are written once, by the tasks that read them, bucketed by their run; later passes over the runs read them in
place, and only small answers are shuffled to them. A question is a set of items of one run. It is split by a hash of
the items into shares; whoever judges a share sees the items of all runs, and answers each run with one value per item,
in the run's own order. A run sends an item once however often it holds it, so that a hot item has as many copies as
there are runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.registry import small_batches
from corpusloom.session import scratch_path

#: Bytes of text in a run, about; also sets the number of shares.
RUN_BYTES = 16 << 20
#: Buckets of a written table; the engine's own bound is 100,000. A bucket of a larger table holds several runs.
MOST_BUCKETS = 50_000
ASK = "share long, run long, kind int, items binary"
ANSWER = "run long, kind int, share long, answer binary"


class Runs:
    """Texts (run, row, doc_id, text) by run. ``row`` is unique, so repeated and null ids do no harm.

    ``stored`` also has the column ``rest`` if the rows do.
    """

    def __init__(self, rows: DataFrame, name: str):
        spark = rows.sparkSession
        small_batches(spark, 200)
        size, count = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
        self.shares = max(4, -(-size // RUN_BYTES))
        together = max(1, count * RUN_BYTES // max(1, size))  # rows of a run
        table = f"{name}_{uuid.uuid4().hex}"
        (
            rows.select(F.monotonically_increasing_id().alias("row"), *rows.columns)
            .select(
                (F.shiftright("row", 33) * (1 << 33) + F.floor(F.col("row").bitwiseAND((1 << 33) - 1) / together)).alias("run"),
                "row",
                *rows.columns,
            )
            .write.format("parquet")
            .option("path", scratch_path(spark, name))
            .option("compression", "zstd")
            .bucketBy(min(self.shares, MOST_BUCKETS), "run")
            .sortBy("run")
            .saveAsTable(table)
        )
        self.stored = spark.table(table)
        self.texts = self.stored.select("run", "row", "doc_id", "text")

    def ask(self, question: Callable[[pa.Table, dict[int, dict[int, bytes]]], Iterable], kind: int, answers=None):
        """Rows of ASK: ``question`` yields (share, items) for a run, given earlier answers by kind and share."""

        def rows(texts: pa.Table, given: dict) -> pa.Table:
            found = [(share, items) for share, items in question(texts, given)]
            run = texts.column("run")[0].as_py()
            return pa.table(
                [
                    pa.array([s for s, _ in found], pa.int64()),
                    pa.array([run] * len(found), pa.int64()),
                    pa.array([kind] * len(found), pa.int32()),
                    pa.array([i for _, i in found], pa.binary()),
                ],
                names=["share", "run", "kind", "items"],
            )

        return self.each(rows, ASK, answers)

    def each(self, function, schema: str, answers: DataFrame | None = None, columns: tuple = ("run", "share", "answer", "kind")):
        """``function(texts, answers by kind and share)`` for every run."""
        if answers is None:
            return self.texts.groupBy("run").applyInArrow(lambda texts: function(texts, {}), schema)

        empty = _empty(schema)

        def both(texts: pa.Table, replies: pa.Table) -> pa.Table:
            given: dict[int, dict[int, bytes]] = {}
            for kind, share, answer in zip(*(replies.column(c).to_pylist() for c in ("kind", "share", "answer")), strict=True):
                given.setdefault(kind, {})[share] = answer
            return function(texts, given) if texts.num_rows else empty

        return self.texts.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(both, schema)


def _empty(schema: str) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema)).empty_table()


def judged(asked: DataFrame, judge: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Rows of ANSWER: ``judge`` gets the items of all runs for one share and gives an answer for each."""

    def share(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("run").to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        answers = judge([x.as_buffer() for x in rows.column("items")])
        return pa.table(
            [rows.column("run"), rows.column("kind"), rows.column("share"), pa.array([bytes(a) for a in answers], pa.binary())],
            names=["run", "kind", "share", "answer"],
        )

    return asked.groupBy("share").applyInArrow(share, ANSWER)


def kept_answers(answers: DataFrame, name: str) -> DataFrame:
    """Answers written to the shared folder, as several passes read them."""
    path = scratch_path(answers.sparkSession, name)
    answers.write.parquet(path)
    return answers.sparkSession.read.parquet(path)


def shares_of(values: np.ndarray, shares: int) -> np.ndarray:
    """Share of each of some sorted 64-bit hashes: equal ranges of their upper 32 bits."""
    return (((values >> np.uint64(32)) * np.uint64(shares)) >> np.uint64(32)).astype(np.int64)


def cut_by_share(sorted_shares: np.ndarray, shares: int):
    """(share, from, to) of the shares that have items."""
    edges = np.searchsorted(sorted_shares, np.arange(shares + 1))
    return [(s, int(a), int(b)) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]


def pack_hashes(values: np.ndarray, dropped: int, *flags: np.ndarray) -> bytes:
    """Sorted hashes without their lowest bits as differences, then bit sets."""
    short = values >> np.uint64(dropped)
    steps = np.diff(short, prepend=np.uint64(0))
    steps[0] = 0
    kind = next(k for k in ("<u2", "<u4", "<u8") if int(steps.max(initial=0)) <= np.iinfo(k).max)
    head = np.array([len(values), int(kind[2]), int(short[0]) if len(short) else 0], "<u8")
    return b"".join([head.tobytes(), steps.astype(kind).tobytes(), *(np.packbits(f).tobytes() for f in flags)])


def unpack_hashes(blob, flags: int) -> list[np.ndarray]:
    n, width, first = (int(x) for x in np.frombuffer(blob, "<u8", 3))
    steps = np.frombuffer(blob, f"<u{width}", n, 24).astype(np.uint64)
    out, at = [np.cumsum(steps) + np.uint64(first)], 24 + n * width
    for _ in range(flags):
        out.append(np.unpackbits(np.frombuffer(blob, np.uint8, -(-n // 8), at), count=n).astype(bool))
        at += -(-n // 8)
    return out
