"""Memory epochs as messages arrive."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.transcripts import MEMORY_TOKENS

OUTPUT = "conv_id bigint, turn bigint, total bigint, epoch int, compressed boolean"
STATE = "total bigint, epoch int, expected bigint, turns array<bigint>, costs array<bigint>"


def stream_memory_epochs(
    costs: DataFrame,
    threshold: int = MEMORY_TOKENS,
    base_tokens: int = 0,
    summary_tokens: int = 0,
    first_turn: int = 0,
) -> DataFrame:
    """Same rows as ``memory_epochs`` for a stream of (conv_id, turn, cost); a NULL cost is 0.

    Turns of a conversation count up by one from ``first_turn`` and may arrive in any order over batches: the state keeps
    the memory so far, the turn expected next, and messages that came too early, which wait until the gap is filled. A
    turn that has already been counted is left out, so a repeated message changes nothing.
    """
    after = base_tokens + summary_tokens

    def scan(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        total, epoch, expected, turns, prices = (
            state.get if state.exists else (base_tokens, 0, first_turn, [], [])
        )
        turns, prices = [np.array(turns, np.int64)], [np.array(prices, np.int64)]
        for rows in batches:
            turns.append(rows["turn"].to_numpy(np.int64))
            prices.append(rows["cost"].fillna(0).to_numpy(np.int64))
        turns, where = np.unique(np.concatenate(turns), return_index=True)
        prices = np.concatenate(prices)[where]
        prices, turns = prices[turns >= expected], turns[turns >= expected]
        gaps = np.flatnonzero(turns != expected + np.arange(len(turns)))
        n = int(gaps[0]) if len(gaps) else len(turns)
        sums = np.cumsum(prices[:n])
        totals, epochs, full = np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, bool)
        at, before = 0, 0
        while at < n:
            hit = at + int(np.searchsorted(sums[at:], threshold - total + before))
            upto = min(hit + 1, n)
            totals[at:upto] = total + sums[at:upto] - before
            epochs[at:upto] = epoch
            if hit < n:
                full[hit] = True
                total, epoch, before = after, epoch + 1, int(sums[hit])
            else:
                total = int(totals[-1])
            at = upto
        state.update((total, epoch, expected + n, turns[n:].tolist(), prices[n:].tolist()))
        yield pd.DataFrame(
            {"conv_id": key[0], "turn": turns[:n], "total": totals, "epoch": epochs, "compressed": full}
        )

    return (
        costs.select("conv_id", "turn", "cost")
        .groupBy("conv_id")
        .applyInPandasWithState(scan, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
    )
