"""Removal of repeated passages by fixed-block anchors.

Every text's words are cut into non-overlapping reference blocks, which are indexed by hash. All texts probe the index
with every rolling run of as many words. A window of ``window`` words holds a whole reference block of each of its
occurrences, so a window that occurs twice has hits; hits are extended to the windows around them, which are compared by
128-bit digests (each half from another half of the words' 128-bit digests), and runs of repeated windows make the maximal exact repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.registry import query, table, texts
from corpusloom.llm.runs import Runs, cut_by_share, judged, kept_answers, pack_hashes, shares_of, unpack_hashes
from corpusloom.llm.words import as_binary, join_kept, parts_of, run_starts, runs_of_words, words_of

#: Lowest bits of a block's hash that are not sent: 48 remain, and a chance hit only costs a needless comparison.
DROPPED = 16
BLOCKS, WINDOWS = 1, 2
WINDOW = np.dtype([("high", "<u8"), ("low", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("start", "<i4")])


class _Run:
    """Word hashes of all texts of a run, and its rolling blocks."""

    def __init__(self, rows: pa.Table, block: int, window: int, shares: int):
        self.block, self.window, self.shares = block, window, shares
        hashes, others, counts = [], [], []
        for _, part in parts_of(rows.column("text")):
            words = words_of(part)
            hashes.append(words.hash)
            others.append(words.other)
            counts.append(np.diff(words.first))
        self.words, self.others = np.concatenate(hashes), np.concatenate(others)
        self.first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        starts = run_starts(self.first, block)
        self.starts = starts
        self.values = runs_of_words(self.words, block)[starts] >> np.uint64(DROPPED) << np.uint64(DROPPED)
        text = np.repeat(np.arange(len(self.first) - 1), np.maximum(np.diff(self.first) - block + 1, 0))
        aligned = (starts - self.first[text]) % block == 0
        marked = np.sort(self.values | aligned.astype(np.uint64))
        plain = marked >> np.uint64(1)
        begins = np.flatnonzero(np.diff(plain, prepend=~plain[:1]) != 0) if len(plain) else np.empty(0, np.int64)
        ends = np.append(begins[1:], len(plain))
        self.distinct = plain[begins] << np.uint64(1)
        self.reference = (marked[ends - 1] & np.uint64(1)).astype(bool) if len(begins) else np.empty(0, bool)
        self.often = ends - begins > 1

    def blocks(self):
        for share, a, b in cut_by_share(shares_of(self.distinct, self.shares), self.shares):
            yield share, pack_hashes(self.distinct[a:b], DROPPED, self.reference[a:b], self.often[a:b])

    def windows(self, rows: pa.Table, given: dict):
        """Windows that hold a hit: the starts of all, their digests, and the order of the run's first occurrences."""
        live = np.zeros(len(self.distinct), bool)
        for share, a, b in cut_by_share(shares_of(self.distinct, self.shares), self.shares):
            live[a:b] = np.unpackbits(np.frombuffer(given[BLOCKS][share], np.uint8), count=b - a)
        wanted = self.distinct[live]
        near = np.minimum(np.searchsorted(wanted, self.values), max(0, len(wanted) - 1))
        hit = wanted[near] == self.values if len(wanted) else np.zeros(len(self.values), bool)
        sums = np.zeros(len(self.words) + 2, np.int64)
        sums[self.starts[hit] + 1] = 1
        sums = np.cumsum(sums)
        starts = run_starts(self.first, self.window)
        starts = starts[sums[starts + self.window - self.block + 1] > sums[starts]]
        found = np.zeros(len(starts), WINDOW)
        found["high"] = runs_of_words(self.words, self.window, 1)[starts]
        found["low"] = runs_of_words(self.others, self.window, 2)[starts]
        text = np.searchsorted(self.first, starts, "right") - 1
        ids = rows.column("doc_id").combine_chunks().fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        found["doc"] = ids[text]
        found["row"] = rows.column("row").to_numpy()[text]
        found["start"] = starts - self.first[text]
        order = np.lexsort([found[c] for c in ("start", "row", "doc", "low", "high")])
        ordered = found[order]
        new = _differs(ordered)
        return starts, order, ordered, new


def _differs(ordered: np.ndarray) -> np.ndarray:
    """Whether each of some sorted windows differs from the one before."""
    new = np.ones(len(ordered), bool)
    new[1:] = (ordered["high"][1:] != ordered["high"][:-1]) | (ordered["low"][1:] != ordered["low"][:-1])
    return new


def _judge_blocks(asked: list) -> list[bytes]:
    """A hash is live if it is a reference block somewhere and occurs at two places or more."""
    parts = [unpack_hashes(x, 2) for x in asked]
    values = np.concatenate([p[0] for p in parts])
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    reference = np.concatenate([p[1] for p in parts])[order]
    often = np.concatenate([p[2] for p in parts])[order]
    count = np.add.reduceat(1 + often.astype(np.int64), begins)
    live = (count > 1) & np.logical_or.reduceat(reference, begins)
    back = np.empty(len(values), bool)
    back[order] = np.repeat(live, np.diff(np.append(begins, len(values))))
    edges = np.cumsum([0, *(len(p[0]) for p in parts)])
    return [np.packbits(back[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _judge_windows(asked: list) -> list[bytes]:
    """Marks the first occurrence of every window."""
    parts = [np.frombuffer(x, WINDOW) for x in asked]
    found = np.concatenate(parts)
    order = np.lexsort([found[c] for c in ("start", "row", "doc", "low", "high")])
    first = np.empty(len(found), bool)
    first[order] = _differs(found[order])
    edges = np.cumsum([0, *map(len, parts)])
    return [np.packbits(first[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def drop_repeated_passages(
    docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, spans of removed words, and the kept words as ``kept``; with
    ``carry`` also ``rest``, a struct of those columns.

    A word goes if it lies in a window of ``window`` words (2 at least) of its text whose sequence of words starts
    earlier: in a text of smaller id, or earlier in the same text. Windows are judged on the input. ``spans`` are
    (start, length) in words of the maximal removed runs, ``kept`` is the UTF-8 of the kept words joined by one space,
    ``text`` the input text.

    A null or empty text, or one of separators only, has no words. Rows with null ids come before all others; rows with
    equal ids are told apart by their place in the table, so a repeated row is a later copy. An empty table gives no
    rows. Other columns are ignored.

    Texts are written once to the shared folder and never shuffled; see ``runs``. A passage that very many texts share
    costs one item for each run and window, not for each occurrence.
    """
    block = (window + 1) // 2  # the longest of which every window holds an aligned one
    runs = Runs(texts(docs, doc_id, text, carry), "passages")
    shares = runs.shares

    def ask_blocks(rows, _):
        return _Run(rows, block, window, shares).blocks()

    def ask_windows(rows, given):
        _, _, ordered, new = _Run(rows, block, window, shares).windows(rows, given)
        ordered = ordered[new]
        return [(s, ordered[a:b].tobytes()) for s, a, b in cut_by_share(shares_of(ordered["high"], shares), shares)]

    live = kept_answers(judged(runs.ask(ask_blocks, BLOCKS), _judge_blocks), "passages-live")
    first = kept_answers(judged(runs.ask(ask_windows, WINDOWS, live), _judge_windows), "passages-first")

    def drop(rows, given):
        run = _Run(rows, block, window, shares)
        starts, order, ordered, new = run.windows(rows, given)
        kept_here = np.zeros(len(ordered), bool)
        firsts = np.flatnonzero(new)
        for share, a, b in cut_by_share(shares_of(ordered["high"][firsts], shares), shares):
            kept_here[firsts[a:b]] = np.unpackbits(np.frombuffer(given[WINDOWS][share], np.uint8), count=b - a)
        gone = starts[order[~kept_here]]
        cover = np.zeros(len(run.words) + window + 1, np.int32)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + window, -1)
        removed = np.cumsum(cover)[: len(run.words)] > 0
        edge = np.zeros(len(run.words) + 1, bool)
        edge[run.first] = True
        begins = np.flatnonzero(removed & (edge[:-1] | ~np.concatenate([[False], removed[:-1]])[: len(removed)]))
        ends = np.flatnonzero(removed & (edge[1:] | ~np.concatenate([removed[1:], [False]])[: len(removed)])) + 1
        of = np.searchsorted(run.first, begins, "right") - 1
        spans = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(of, np.arange(len(run.first))), pa.int32()),
            pa.StructArray.from_arrays(
                [pa.array(begins - run.first[of], pa.int64()), pa.array(ends - begins, pa.int64())], ["start", "length"]
            ),
        )
        kept = []
        for at, part in parts_of(rows.column("text")):
            a, b = run.first[at], run.first[at + len(part)]
            kept.append(as_binary(*join_kept(words_of(part), ~removed[a:b])))
        counts = np.concatenate([[0], np.cumsum(removed)])
        return pa.table(
            [
                rows.column("doc_id"),
                pa.array(np.diff(run.first), pa.int64()),
                pa.array(np.diff(counts[run.first]), pa.int64()),
                spans,
                pa.chunked_array(kept, pa.large_binary()).cast(pa.binary()),
                rows.column("run"),
                rows.column("row"),
            ],
            names=["doc_id", "n_words", "n_removed", "spans", "kept", "run", "row"],
        )

    result = runs.each(
        drop,
        "doc_id long, n_words long, n_removed long, spans array<struct<start:long,length:long>>, kept binary, "
        "run long, row long",
        live.unionByName(first),
    )
    if carry is None:
        return result.drop("run")
    return result.join(runs.stored.select("run", "row", "text", "rest"), ["run", "row"]).drop("run")


@query()
def op9_substrings(spark, sf_dir):
    return drop_repeated_passages(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )
