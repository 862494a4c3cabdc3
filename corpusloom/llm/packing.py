"""Sum-of-squares online packing of documents into windows of a fixed number of tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.registry import query, small_batches, table, texts
from corpusloom.llm.vocabularies import LibraryEncoder, built, read_vocabulary

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class SumOfSquares:
    """Packs pieces (doc, start, doc_tokens, ids) as they come.

    ``levels[h]`` counts the open windows with ``h`` tokens. A piece of ``s`` tokens goes to the level for which the sum
    of the squared counts afterwards is least: moving a window from h to h + s adds 2 (levels[h + s] - levels[h]) + 2,
    opening one adds 2 levels[s] + 1, and a full window counts no more. Ties go to the fullest window.
    """

    def __init__(self, size: int, max_open: int, emit):
        self.size, self.max_open, self.emit = size, max_open, emit
        self.levels = np.zeros(size + 1, np.int64)
        self.windows: list[list[list]] = [[] for _ in range(size)]
        self.open = 0

    def add(self, doc, start: int, doc_tokens: int, ids: np.ndarray) -> None:
        whole = len(ids) // self.size * self.size
        for at in range(0, whole, self.size):
            self.emit([(doc, start + at, doc_tokens, ids[at : at + self.size])])
        if whole < len(ids):
            self._place((doc, start + whole, doc_tokens, ids[whole:]))

    def _place(self, piece) -> None:
        size, levels, s = self.size, self.levels, len(piece[3])
        after = levels[s : size + 1] * 2 + 1  # at [h]: what a window of h + s tokens adds
        after[-1] = 0
        change = after - 2 * levels[: size + 1 - s] + 1
        change[1:][levels[1 : size + 1 - s] == 0] = np.iinfo(np.int64).max
        change[0] = after[0]
        h = len(change) - 1 - int(np.argmin(change[::-1]))
        if h:
            window = self.windows[h].pop()
            levels[h] -= 1
        else:
            window = []
            self.open += 1
        window.append(piece)
        if h + s == size:
            self.emit(window)
            self.open -= 1
        else:
            self.windows[h + s].append(window)
            levels[h + s] += 1
            if self.open > self.max_open:
                self.close(keep_tail=True)

    def close(self, keep_tail: bool = False) -> None:
        """Refill the open windows from each other by cutting; a tail is cut into powers of two, which need no padding."""
        left = [p for same in reversed(self.windows) for window in same for p in window]
        self.levels[:] = 0
        self.windows = [[] for _ in range(self.size)]
        self.open = 0
        total = sum(len(p[3]) for p in left)
        goals = [self.size] * (total // self.size)
        rest = total % self.size
        if not keep_tail:
            goals += [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        left.reverse()
        for goal in goals:
            window, room = [], goal
            while room:
                doc, start, doc_tokens, ids = left.pop()
                window.append((doc, start, doc_tokens, ids[:room]))
                if len(ids) > room:
                    left.append((doc, start + room, doc_tokens, ids[room:]))
                room -= min(room, len(ids))
            self.emit(window)
        for piece in left:
            self._place(piece)


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    size: int = 2048,
    end_id: int = 1,
    max_open: int = 4096,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of documents and their places: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers, ``doc_tokens`` the tokens of its document
    with ``end_id``, ``start`` how many of them come before the piece. Within a sequence the pieces lie without gaps.

    Each input partition is packed as a stream of its own, so there is no shuffle, and a lost task packs the same rows
    the same way again. Sequence ids are the partition's number and a running number. Full windows of a long document
    are cut off first; its rest is placed by the sum of squares. Memory holds open windows only: beyond ``max_open`` of
    them, and at the end, they are refilled from each other by cutting. What remains then, less than one window for a
    partition, becomes sequences of a power of two tokens, so no sequence is padded.

    A null or empty text is the one token ``end_id``. Repeated rows and null ids are packed as they are. An empty table
    gives no rows. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    content, kind, version = read_vocabulary(vocabulary)
    shipped = spark.sparkContext.broadcast(content)

    def pack(batches):
        encoder = built(version, lambda: LibraryEncoder(shipped.value, kind))
        first = TaskContext.get().partitionId() << 33
        rows, made = [], [0]

        def emit(window):
            offset = 0
            for doc, start, doc_tokens, ids in window:
                rows.append((doc, start, len(ids), doc_tokens, first + made[0], offset, ids.tobytes()))
                offset += len(ids)
            made[0] += 1

        def flush():
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 6 + [pa.binary()]
            out = pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )
            rows.clear()
            return out

        packer = SumOfSquares(size, max_open, emit)
        for batch in batches:
            for doc, value in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = encoder.ids(value.as_py())
                ids.append(end_id)
                packer.add(doc.as_py(), 0, len(ids), np.array(ids, "<u4"))
            yield flush()
        packer.close()
        yield flush()

    return texts(docs, doc_id, text).mapInArrow(pack, PIECES)


@query()
def op5_packing(spark, sf_dir):
    import public_tokenizers

    return pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    ).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
