"""Memory epochs of conversations cut into ranges of turns, in numpy.

Messages add their cost to a memory; one that brings it to a threshold sets it back. Of a stretch whose memory at entry is
not known, the first compression depends on the memory, and all later ones on the first. So a stretch is a step function of
its entry, with at most one step for each sum of costs below the threshold. Stretches compose by looking up one step each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext


@dataclass(frozen=True)
class Rule:
    """Memory of ``base`` tokens at first; at ``threshold`` it is set to ``after``."""

    threshold: int
    base: int
    after: int

    def scan(self, costs: np.ndarray, start: np.ndarray, total: np.ndarray, epoch: np.ndarray):
        """(totals, epochs, compressed) of messages in conversations that begin at ``start`` with a memory of ``total``.

        Sums of costs never fall, so the next compression of all conversations is one sorted search; a round finds one of
        each.
        """
        n = len(costs)
        sums, end = np.cumsum(costs), np.append(start[1:], n)
        added = total - (sums[start] - costs[start])  # what a running sum lacks to be the memory
        full, new, value = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int64)
        new[start], value[start] = True, added
        live, at, more = np.arange(len(start)), start, added
        while len(live):
            hit = np.maximum(np.searchsorted(sums, self.threshold - more), at)
            inside = hit < end[live]
            live, hit = live[inside], hit[inside]
            full[hit] = True
            at, more = hit + 1, self.after - sums[hit]
            follow = at < end[live]
            live, at, more = live[follow], at[follow], more[follow]
            new[at], value[at] = True, more
        last = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        counts = np.cumsum(full) - full
        of = np.repeat(np.arange(len(start)), end - start)
        return sums + value[last], epoch[of] + counts - counts[start][of], full

    def exit_of(self, totals: np.ndarray, epochs: np.ndarray, full: np.ndarray) -> tuple[int, int]:
        """Memory and epoch behind the last of some messages."""
        return (self.after, int(epochs[-1]) + 1) if full[-1] else (int(totals[-1]), int(epochs[-1]))

    def steps(self, costs: np.ndarray):
        """(reach, total, epochs): entered with a memory that ``reach`` brings to the threshold, and no smaller reach, a
        stretch ends with ``total`` after so many compressions."""
        sums = np.cumsum(costs)
        before = np.append(-1, sums[:-1])
        first = np.flatnonzero((sums > before) & (before < self.threshold))
        first = first if len(first) and first[0] == 0 else np.append(0, first)
        n = len(sums)
        ahead = np.maximum(np.searchsorted(sums, sums + self.threshold - self.after), np.arange(1, n + 1))
        goes = ahead < n
        last = np.where(goes, ahead, np.arange(n))
        count = goes.astype(np.int64)
        while True:  # pointers of doubled length, until all end at the last compression
            further = last[last]
            if np.array_equal(further, last):
                break
            count += count[last]
            last = further
        return sums[first], self.after + sums[-1] - sums[last[first]], 1 + count[first]


def _breaks(keys: pa.Array) -> np.ndarray:
    """Places at which another key begins, the first one included."""
    a, b = keys.slice(1), keys.slice(0, len(keys) - 1)
    differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    void = keys.is_null().to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(differs | (void[1:] != void[:-1])) + 1])


def _table(keys, turns, part: int, **columns) -> pa.RecordBatch:
    """Rows of ``scan_ranges``; what is not given is null."""
    n = len(keys)
    given = {"total": None, "epoch": None, "compressed": None, "cost": None, "steps": None} | columns
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), STEPS]
    return pa.record_batch(
        [
            pa.repeat(pa.scalar(part, pa.int32()), n), keys, turns,
            *(pa.nulls(n, t) if x is None else pa.array(x, t) for x, t in zip(given.values(), kinds)),
        ],
        names=["part", "key", "turn", *given],
    )


STEPS = pa.struct(
    [("lead", pa.bool_()), ("reach", pa.list_(pa.int64())), ("total", pa.list_(pa.int64())), ("epoch", pa.list_(pa.int64())), ("sum", pa.int64())]
)
STEPS_SQL = "struct<lead:boolean,reach:array<bigint>,total:array<bigint>,epoch:array<bigint>,sum:bigint>"


def scan_ranges(rule: Rule):
    """Arrow function over (key, turn, cost) of one range, sorted.

    Conversations that begin inside the range are counted at once. The one in front may have begun before: its messages
    leave with their cost only, and with one row of its steps. The last one leaves a row of its memory, as it may go on in
    the next range. These rows have no turn. Held are the costs of the conversation in front, and one batch.
    """

    def edge(keys, part, lead, reach, total, epoch, sum_):
        held = [{"lead": lead, "reach": reach, "total": total, "epoch": epoch, "sum": sum_}]
        return _table(keys, pa.nulls(1, pa.int64()), part, steps=held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, front, front_key, last, state = TaskContext.get().partitionId(), [], None, (), None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, turns, costs = batch.columns
            costs = costs.to_numpy()
            start = _breaks(keys)
            same = last == (keys[0].as_py(),)
            if front_key is None:
                front_key = keys.slice(0, 1)
            leading = 0
            if state is None and (same or not last):
                leading = int(start[1]) if len(start) > 1 else len(costs)
                front.append(costs[:leading])
                yield _table(keys.slice(0, leading), turns.slice(0, leading), part, cost=costs[:leading])
                start = start[1:]
            if leading < len(costs):
                total = np.full(len(start), rule.base, np.int64)
                epoch = np.zeros(len(start), np.int64)
                if same and state is not None:
                    total[0], epoch[0] = state
                totals, epochs, full = rule.scan(costs[leading:], start - leading, total, epoch)
                yield _table(
                    keys.slice(leading), turns.slice(leading), part, total=totals, epoch=epochs.astype(np.int32), compressed=full
                )
                state = rule.exit_of(totals, epochs, full)
            last, last_key = (keys[-1].as_py(),), keys.slice(len(keys) - 1)
        if front:
            costs = np.concatenate(front)
            reach, total, epoch = rule.steps(costs)
            yield edge(front_key, part, True, reach.tolist(), total.tolist(), epoch.tolist(), int(costs.sum()))
        if state is not None:
            yield edge(last_key, part, False, [], [state[0]], [state[1]], 0)

    return run


def follow_ranges(rule: Rule):
    """Arrow function over edge rows (part, key, steps), sorted by key and part: (part, total, epoch) at the entry of the
    conversation in front of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            parts, totals, epochs = [], [], []
            for part, now, steps in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or now != key:
                    key, state = now, (rule.base, 0)
                if not steps["lead"]:
                    state = steps["total"][0], steps["epoch"][0]
                    continue
                parts.append(part)
                totals.append(state[0])
                epochs.append(state[1])
                at = int(np.searchsorted(steps["reach"], rule.threshold - state[0]))
                if at < len(steps["reach"]):
                    state = steps["total"][at], state[1] + steps["epoch"][at]
                else:
                    state = state[0] + steps["sum"], state[1]
            yield pa.record_batch(
                [pa.array(parts, pa.int32()), pa.array(totals, pa.int64()), pa.array(epochs, pa.int64())],
                names=["part", "in_total", "in_epoch"],
            )

    return run


def scan_fronts(rule: Rule):
    """Arrow function over (part, key, turn, cost, in_total, in_epoch) of conversations in front, sorted by part and turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            parts, keys, turns, costs, total, epoch = batch.columns
            start = _breaks(parts)
            total, epoch = total.to_numpy()[start].copy(), epoch.to_numpy()[start].copy()
            if parts[0].as_py() == last:
                total[0], epoch[0] = state
            totals, epochs, full = rule.scan(costs.to_numpy(), start, total, epoch)
            last, state = parts[-1].as_py(), rule.exit_of(totals, epochs, full)
            yield pa.record_batch(
                [keys, turns, pa.array(totals), pa.array(epochs.astype(np.int32)), pa.array(full)],
                names=["key", "turn", "total", "epoch", "compressed"],
            )

    return run
