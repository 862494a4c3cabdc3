"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A sparse suffix array is enough for strings of a fixed length: every window of ``length`` bytes elects the place whose
next ``seed`` bytes have the least hash in it, so equal windows elect equal places, and a repeated window shows at the
elected suffixes of its occurrences. About one suffix in seventy is elected; those whose seed occurs once in all texts
cannot matter and are left out before the sort.

Each run sorts the suffixes it elected, each followed by the bytes before it in reverse, and sends them front-coded:
length of the prefix shared with the one before, and the rest. A share merges the runs with a loser tree that keeps the
common prefix of every loser with the winner it lost to, so that no byte known to be equal is compared again, and that
yields the common prefixes of the merged order. From these, and from those of the order of the bytes before, follow the
windows that occur twice, by ranks alone and without hashing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.registry import query, table, texts
from corpusloom.llm.runs import Runs, cut_by_share, judged, kept_answers, pack_hashes, shares_of, unpack_hashes
from corpusloom.llm.words import as_binary, buffer_of, mix, parts_of, powers, prefix_sums

SEEDS, SUFFIXES = 1, 2
#: Lowest bits of a seed's hash that are not sent; a chance hit only sorts a suffix in vain.
DROPPED = 16
NEVER = 65535


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of every ``width`` consecutive values, the leftmost of equal ones; values are 64-bit hashes."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at, reach = values, np.arange(len(values)), 1
    while reach * 2 <= width:
        take = best[reach:] < best[:-reach]
        at = np.where(take, at[reach:], at[:-reach])
        best = np.minimum(best[reach:], best[:-reach])
        reach *= 2
    rest = width - reach
    if not rest:
        return at[:n]
    take = best[rest:] < best[:-rest]
    return np.where(take, at[rest:], at[:-rest])[:n]


def elected(data: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes of their seeds), each once, of the windows of all texts; no window crosses two texts."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    sums = prefix_sums(data)
    count = len(data) - seed + 1
    values = mix((sums[seed:] - sums[:-seed]) * powers(count, inverse=True))
    at = sliding_minimum(values, length - seed + 1)
    sizes = np.diff(offsets)
    inside = np.zeros(len(data) + 1, np.int32)
    fits = sizes >= length
    np.add.at(inside, offsets[:-1][fits], 1)
    np.add.at(inside, offsets[1:][fits] - length + 1, -1)
    chosen = np.zeros(count, bool)
    chosen[at[np.cumsum(inside)[: len(at)] > 0]] = True
    places = np.flatnonzero(chosen)
    return places, mix(values[places])  # elected hashes are small ones; mixed again they spread over the shares


class _Run:
    """Elected places of a run's texts."""

    def __init__(self, rows: pa.Table, length: int, seed: int, shares: int):
        self.length, self.seed, self.shares = length, seed, shares
        self.parts, hashes = [], []
        for at, part in parts_of(rows.column("text")):
            data, offsets = buffer_of(part)
            places, values = elected(data, offsets, length, seed)
            self.parts.append((at, data, offsets, places))
            hashes.append(values)
        self.hash = np.concatenate(hashes) >> np.uint64(DROPPED) << np.uint64(DROPPED)
        ordered = np.sort(self.hash)
        begins = np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]) != 0) if len(ordered) else np.empty(0, np.int64)
        self.distinct = ordered[begins]
        self.often = np.diff(np.append(begins, len(ordered))) > 1

    def seeds(self):
        for share, a, b in cut_by_share(shares_of(self.distinct, self.shares), self.shares):
            yield share, pack_hashes(self.distinct[a:b], DROPPED, self.often[a:b])

    def suffixes(self, given: dict):
        """The distinct suffixes by share: (share, sorted strings, their sides' lengths, whether they repeat), and which
        suffix each elected place has: (share, number), both -1 for a place that cannot matter."""
        live = np.zeros(len(self.distinct), bool)
        for share, a, b in cut_by_share(shares_of(self.distinct, self.shares), self.shares):
            live[a:b] = np.unpackbits(np.frombuffer(given[SEEDS][share], np.uint8), count=b - a)
        wanted = live[np.searchsorted(self.distinct, self.hash)] if len(self.hash) else np.empty(0, bool)
        share = np.where(wanted, shares_of(self.hash, self.shares), -1)
        number = np.full(len(share), -1, np.int64)
        right, left = self.length, self.length - self.seed
        by_share: dict[int, list] = {}
        base = 0
        for _, data, offsets, places in self.parts:
            use = np.flatnonzero(wanted[base : base + len(places)])
            at = places[use]
            text = np.searchsorted(offsets, at, "right") - 1
            ahead = np.minimum(offsets[text + 1] - at, right)
            behind = np.minimum(at - offsets[text], left)
            raw = data.tobytes()
            back = raw[::-1]
            n = len(raw)
            for k, p, r, b in zip((base + use).tolist(), at.tolist(), ahead.tolist(), behind.tolist(), strict=True):
                string = raw[p : p + r].ljust(right, b"\0") + back[n - p : n - p + b].ljust(left, b"\0")
                by_share.setdefault(int(share[k]), []).append((string, r, b, k))
            base += len(places)
        out = []
        for s in sorted(by_share):
            items = sorted(by_share[s])
            strings, sides, often = [], [], []
            for string, r, b, k in items:
                if strings and strings[-1] == string and sides[-1] == (r, b):
                    often[-1] = True
                else:
                    strings.append(string)
                    sides.append((r, b))
                    often.append(False)
                number[k] = len(strings) - 1
            out.append((s, strings, np.array(sides, "<u2"), np.array(often)))
        return out, share, number


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings of equal length that agree in the first ``known`` bytes."""
    differ = int.from_bytes(a[known:]) ^ int.from_bytes(b[known:])
    return len(a) - (differ.bit_length() + 7) // 8


def front_coded(strings: list[bytes], sides: np.ndarray, often: np.ndarray) -> bytes:
    """A sorted run of strings of equal length: count, shared prefixes, sides, marks, then the rests one after another."""
    shared, rests, before = [], [], None
    for string in strings:
        common = shared_prefix(before, string, 0) if before is not None else 0
        shared.append(common)
        rests.append(string[common:])
        before = string
    head = np.array([len(strings), len(strings[0])], "<u4")
    return b"".join(
        [head.tobytes(), np.array(shared, "<u2").tobytes(), sides.tobytes(), np.packbits(often).tobytes(), *rests]
    )


class CodedRun:
    """Reads a front-coded run string by string."""

    def __init__(self, blob):
        blob = memoryview(blob)
        self.n, self.width = (int(x) for x in np.frombuffer(blob, "<u4", 2))
        self.shared = np.frombuffer(blob, "<u2", self.n, 8).tolist()
        self.sides = np.frombuffer(blob, "<u2", 2 * self.n, 8 + 2 * self.n).reshape(-1, 2)
        at = 8 + 6 * self.n
        self.often = np.unpackbits(np.frombuffer(blob, np.uint8, -(-self.n // 8), at), count=self.n).astype(bool)
        self.rests, self.at, self.next, self.string = blob, at + -(-self.n // 8), 0, b""

    def step(self) -> bool:
        """Go to the next string; False at the end."""
        if self.next == self.n:
            return False
        common = self.shared[self.next]
        upto = self.at + self.width - common
        self.string = self.string[:common] + bytes(self.rests[self.at : upto])
        self.at, self.next = upto, self.next + 1
        return True


def merge_runs(runs: list[CodedRun]):
    """Yields (run, string, prefix shared with the string yielded before) in order; equal strings by run.

    A loser tree: node i holds the run that lost there and the prefix its string shares with the winner that passed. A
    run that comes up anew brings the prefix shared with the last winner, which was its own string before. Of two runs
    the one that shares more with the last winner is smaller; only if they share equally much are bytes compared, from
    there on.
    """
    n = 1 << max(0, len(runs) - 1).bit_length()
    current: list[bytes | None] = [r.string if r.step() else None for r in runs] + [None] * (n - len(runs))
    loser, common = [0] * n, [0] * n

    def play(a: int, pa_: int, b: int, pb: int):
        """(winner, its prefix, loser, its prefix) of two runs with their prefixes shared with the last winner."""
        if current[b] is None:
            return a, pa_, b, 0
        if current[a] is None:
            return b, pb, a, 0
        if pa_ != pb:
            return (a, pa_, b, pb) if pa_ > pb else (b, pb, a, pa_)
        x, y = current[a], current[b]
        both = shared_prefix(x, y, pa_)
        first = a < b if both == len(x) else x[both] < y[both]
        return (a, pa_, b, both) if first else (b, pb, a, both)

    def build(node: int):
        if node >= n:
            return node - n, 0
        (a, x), (b, y) = build(2 * node), build(2 * node + 1)
        winner, kept, loser[node], common[node] = play(a, x, b, y)
        return winner, kept

    winner, prefix = build(1)
    while current[winner] is not None:
        yield winner, current[winner], prefix
        run = runs[winner]
        if run.step():
            current[winner], prefix = run.string, run.shared[run.next - 1]
        else:
            current[winner], prefix = None, 0
        node = (winner + n) >> 1
        while node:
            winner, prefix, loser[node], common[node] = play(winner, prefix, loser[node], common[node])
            node >>= 1


def repeated_offsets(right_common, left, ahead, behind, often, length: int, seed: int):
    """(least, most) distance from the start of a repeated window to each suffix, NEVER and 0 where there is none.

    The suffixes come in their order, ``right_common`` being the prefix each shares with the one before; ``left`` are the
    reversed bytes before them, ``ahead`` and ``behind`` how many real bytes there are on either side. For a window that
    starts d bytes before its suffix, two suffixes agree if they are of one class by the first length - d bytes and of
    one class by the last d bytes before.
    """
    n, most = len(right_common), length - seed
    by_left = sorted(range(n), key=left.__getitem__)
    left_common = np.zeros(n, np.int64)
    for k in range(1, n):
        left_common[k] = shared_prefix(left[by_left[k - 1]], left[by_left[k]], 0)
    by_left = np.array(by_left, np.int64)
    low, high = np.full(n, NEVER, np.int64), np.zeros(n, np.int64)
    left_class = np.empty(n, np.int64)
    for d in range(most + 1):
        valid = (ahead >= length - d) & (behind >= d)
        if not valid.any():
            continue
        right_class = np.cumsum(right_common < length - d)
        left_class[by_left] = np.cumsum(left_common < d)
        at = np.flatnonzero(valid)
        key = right_class[at] * np.int64(n + 1) + left_class[at]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        same = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        hit = at[twice | often[at]]
        low[hit] = np.minimum(low[hit], d)
        high[hit] = d
    return low, high


def _judge_seeds(asked: list) -> list[bytes]:
    """A seed is live if it occurs at two places or more."""
    parts = [unpack_hashes(x, 1) for x in asked]
    values = np.concatenate([p[0] for p in parts])
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    often = np.concatenate([p[1] for p in parts])[order]
    live = np.add.reduceat(1 + often.astype(np.int64), begins) > 1
    back = np.empty(len(values), bool)
    back[order] = np.repeat(live, np.diff(np.append(begins, len(values))))
    edges = np.cumsum([0, *(len(p[0]) for p in parts)])
    return [np.packbits(back[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _judge_suffixes(asked: list, length: int, seed: int) -> list[bytes]:
    runs = [CodedRun(x) for x in asked]
    edges = np.cumsum([0, *(r.n for r in runs)])
    total = int(edges[-1])
    common, places, left = np.zeros(total, np.int64), np.zeros(total, np.int64), []
    for k, (run, string, prefix) in enumerate(merge_runs(runs)):
        common[k] = min(prefix, length)
        places[k] = edges[run] + runs[run].next - 1
        left.append(string[length:])
    sides = np.concatenate([r.sides for r in runs]).astype(np.int64)[places]
    often = np.concatenate([r.often for r in runs])[places]
    low, high = repeated_offsets(common, left, sides[:, 0], sides[:, 1], often, length, seed)
    back = np.empty((2, total), "<u2")
    back[0, places], back[1, places] = low, high
    return [back[:, a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def drop_repeated_bytes(
    docs: DataFrame, length: int = 200, seed: int = 64, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, spans of removed bytes, and the kept bytes.

    A byte of a text's UTF-8 goes if a string of ``length`` bytes over it also starts anywhere else, in the same text or
    another; strings are judged on the input. ``spans`` are (start, length) of the maximal removed runs; ``kept`` may
    begin or end inside a character. ``seed`` (at most ``length``) is how many bytes elect a place.

    A null or empty text, and any shorter than ``length``, loses nothing. Repeated rows are copies of each other, so all
    of them go; null ids are ids like others. An empty table gives no rows. Other columns are ignored.

    Texts are written once to the shared folder and never shuffled; see ``runs``. Equal suffixes of a run are sent once.
    """
    runs = Runs(texts(docs, doc_id, text), "suffixes")
    shares = runs.shares

    def ask_seeds(rows, _):
        return _Run(rows, length, seed, shares).seeds()

    def ask_suffixes(rows, given):
        found, _, _ = _Run(rows, length, seed, shares).suffixes(given)
        return [(s, front_coded(strings, sides, often)) for s, strings, sides, often in found]

    live = kept_answers(judged(runs.ask(ask_seeds, SEEDS), _judge_seeds), "suffixes-live")
    twice = kept_answers(
        judged(runs.ask(ask_suffixes, SUFFIXES, live), lambda asked: _judge_suffixes(asked, length, seed)),
        "suffixes-twice",
    )

    def drop(rows, given):
        run = _Run(rows, length, seed, shares)
        found, share, number = run.suffixes(given)
        low, high = np.full(len(share), NEVER, np.int64), np.zeros(len(share), np.int64)
        for s, strings, _, _ in found:
            answer = np.frombuffer(given[SUFFIXES][s], "<u2").reshape(2, len(strings))
            mine = np.flatnonzero(share == s)
            low[mine], high[mine] = answer[0][number[mine]], answer[1][number[mine]]
        columns: list[list] = [[], [], [], [], []]
        base = 0
        for _, data, offsets, places in run.parts:
            near, far = low[base : base + len(places)], high[base : base + len(places)]
            base += len(places)
            hit = near != NEVER
            cover = np.zeros(len(data) + 1, np.int32)
            np.add.at(cover, places[hit] - far[hit], 1)
            np.add.at(cover, places[hit] - near[hit] + length, -1)
            removed = np.cumsum(cover)[:-1] > 0
            sums = np.concatenate([[0], np.cumsum(removed)])
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            begins = np.flatnonzero(removed & (edge[:-1] | ~np.concatenate([[False], removed])[:-1]))
            ends = np.flatnonzero(removed & (edge[1:] | ~np.concatenate([removed, [False]])[1:])) + 1
            of = np.searchsorted(offsets, begins, "right") - 1
            kept = ~removed
            columns[0].append(pa.array(np.diff(offsets), pa.int64()))
            columns[1].append(pa.array(np.diff(sums[offsets]), pa.int64()))
            columns[2].append(
                pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(of, np.arange(len(offsets))), pa.int32()),
                    pa.StructArray.from_arrays(
                        [pa.array(begins - offsets[of], pa.int64()), pa.array(ends - begins, pa.int64())],
                        ["start", "length"],
                    ),
                )
            )
            columns[3].append(as_binary(data[kept], np.concatenate([[0], np.cumsum(kept)])[offsets]).cast(pa.binary()))
        return pa.table(
            [rows.column("doc_id"), *(pa.chunked_array(c) for c in columns[:4])],
            names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
        )

    return runs.each(
        drop,
        "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,length:long>>, kept binary",
        live.unionByName(twice),
    )


@query()
def op3_suffixes(spark, sf_dir):
    return drop_repeated_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
