"""Exact duplicates by sorting contents.

Texts are put in one order over all tasks: by their normalised bytes' first LEAD bytes, a hash, the bytes themselves and
the id. Splitters that Spark samples from these short keys cut the order into ranges, an external sort places equal texts
next to each other, and neighbours are compared in full. A text that a splitter cuts through is in several ranges; the
runs at the ends of ranges, a few for each, are compared in full once more.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.rows import join_few
from corpusloom.llm.registry import query, table, texts
from corpusloom.llm.words import as_binary, buffer_of
from corpusloom.session import scratch_path

#: Bytes of a text that a splitter holds.
LEAD = 64
#: Ids that travel with one copy of their text; more take a further copy, so that no row or range grows with its group.
MOST_IDS = 256
#: Bytes of text of one range.
RANGE_BYTES = 128 << 20
#: Rows of a batch that goes back to Spark.
OUT_ROWS = 10_000

PIECES = "content binary, ids array<long>, place long"
MEMBERS = (
    "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string, part int, run long, edge binary"
)


def lower_ascii(column: pa.Array) -> pa.Array:
    """The texts' UTF-8 bytes, A-Z in lower case."""
    data, offsets = buffer_of(column)
    return as_binary(data + (((data >= 0x41) & (data <= 0x5A)) << 5).astype(np.uint8), offsets).cast(pa.binary())


def _pieces(largest: bool):
    """Folds the equal texts of a batch: one row for up to MOST_IDS of their ids, of which the first is the one to keep."""

    def fold(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = lower_ascii(batch.column("text")).dictionary_encode()
            codes, ids = coded.indices.to_numpy(), batch.column("doc_id")
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            place = ids.fill_null(0).to_numpy()
            place = ~place if largest else place
            order = np.lexsort((place, missing, codes))
            codes, at = codes[order], np.arange(len(codes))
            begin = np.maximum.accumulate(np.where(np.diff(codes, prepend=-1) != 0, at, 0))
            cuts = np.flatnonzero((at - begin) % MOST_IDS == 0)
            yield pa.record_batch(
                [
                    coded.dictionary.take(pa.array(codes[cuts])),
                    pa.ListArray.from_arrays(pa.array(np.append(cuts, len(at)), pa.int32()), ids.take(pa.array(order))),
                    pa.array(place[order[cuts]], pa.int64(), mask=missing[order[cuts]]),
                ],
                names=["content", "ids", "place"],
            )

    return fold


class _Group:
    """A run of equal texts in a range; ids take 8 bytes each."""

    def __init__(self, content: bytes, mark: int):
        self.content, self.key, self.ids = content, (content[:LEAD], mark), []

    def rows(self, part: int, run: int, edge: bool):
        ids = pa.concat_arrays(self.ids)
        digest = hashlib.sha256(self.content).hexdigest()
        for at in range(0, len(ids), OUT_ROWS):
            some = ids.slice(at, OUT_ROWS)
            n, first = len(some), at == 0
            yield pa.record_batch(
                [
                    some,
                    pa.repeat(ids[0], n),
                    pa.repeat(pa.scalar(len(ids), pa.int64()), n),
                    pa.array(np.arange(at, at + n) == 0),
                    pa.repeat(digest, n),
                    pa.repeat(pa.scalar(part, pa.int32()), n),
                    pa.repeat(pa.scalar(run, pa.int64()), n),
                    pa.array([self.content if edge and first else None] + [None] * (n - 1), pa.binary()),
                ],
                names=[c.split()[0] for c in MEMBERS.split(", ")],
            )


def _groups(batches):
    """(group, whether a splitter may cut through it) of a sorted range, in order."""
    first, held = None, []  # held: the groups of the latest key, mostly one
    for batch in batches:
        content, marks, ids = batch.column("content"), batch.column("mark"), batch.column("ids")
        if not len(content):
            continue
        differs = pc.not_equal(content.slice(1), content.slice(0, len(content) - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(differs) + 1), len(content)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            text = content[a].as_py()
            if not held or held[-1].content != text:
                group = _Group(text, marks[a].as_py())
                if held and held[-1].key != group.key:
                    yield from ((g, g.key == first) for g in held)
                    held = []
                first = first or group.key
                held.append(group)
            held[-1].ids.append(ids.slice(a, b - a).flatten())
    yield from ((g, True) for g in held)


def _members(batches):
    part, ready, size = TaskContext.get().partitionId(), [], 0
    for run, (group, edge) in enumerate(_groups(batches)):
        for rows in group.rows(part, run, edge):
            ready.append(rows)
            size += rows.num_rows
            if size >= OUT_ROWS:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready, size = [], 0
    if ready:
        yield from pa.Table.from_batches(ready).combine_chunks().to_batches()


def exact_copies(
    docs: DataFrame, keep: str = "smallest", doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, keep_id (of the row that stays), group_size, kept, text_sha256.

    Texts are equal if they are after lower-casing A-Z; the digest is of the lower-cased UTF-8. Of equal texts the row of
    the ``keep`` (smallest or largest) id stays. A null text is an empty one. Rows without id stay only where none of
    their group has one (keep_id is null there); of rows with the same id and text one stays, whichever. An empty table
    gives no rows. Other columns are ignored.

    A text leaves a batch once for each 256 of its copies, and ranges are cut by id within a text, so a text that a third
    of the rows have fills many ranges. Texts are shuffled once; a task holds the ids of one run of its range, 8 bytes
    each, and one text.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep!r}")
    largest = keep == "largest"
    spark, rows = docs.sparkSession, texts(docs, doc_id, text)
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    pieces = rows.mapInArrow(_pieces(largest), PIECES).select(
        "content", "ids", "place", F.substring("content", 1, LEAD).alias("lead"), F.xxhash64("content").alias("mark"),
        F.monotonically_increasing_id().alias("tie"),
    )
    place = F.col("place").asc_nulls_last()
    ranged = pieces.repartitionByRange(ranges, "lead", "mark", place, "tie").sortWithinPartitions(
        "lead", "mark", "content", place
    )
    path = scratch_path(spark, "copies")
    ranged.select("content", "ids", "mark").mapInArrow(_members, MEMBERS).write.parquet(path)
    members = spark.read.parquet(path)
    rank = F.bitwise_not("keep_id") if largest else F.col("keep_id")
    ends = members.where(F.col("edge").isNotNull())
    whole = (
        ends.groupBy("edge")
        .agg(
            F.sum("group_size").alias("all_size"),
            F.min(F.struct(F.col("keep_id").isNull(), rank.alias("rank"), "part", F.col("keep_id").alias("keep_id"))).alias("best"),
            F.count(F.lit(1)).alias("runs"),
        )
        .where("runs > 1")
    )
    cut = ends.join(whole, "edge").select(
        "part", "run", "all_size", F.col("best.part").alias("all_part"), F.col("best.keep_id").alias("all_keep")
    )
    joined = join_few(members.drop("edge"), cut, ["part", "run"], "left")
    is_cut = F.col("all_size").isNotNull()
    return joined.select(
        "doc_id",
        F.when(is_cut, F.col("all_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("all_size", "group_size").alias("group_size"),
        (F.col("kept") & F.coalesce(F.col("all_part") == F.col("part"), F.lit(True))).alias("kept"),
        "text_sha256",
    )


SQL = """
with d as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  row_number() over (partition by t order by doc_id desc) = 1 as kept, sha256(t) as text_sha256
from d
"""


@query(SQL)
def op13_copies(spark, sf_dir):
    return exact_copies(table(spark, sf_dir, "documents"), "largest")
