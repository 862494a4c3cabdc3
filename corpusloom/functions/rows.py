"""Exploding arrays, and joining wide rows with short lists of keys."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage


def explode_once(df: DataFrame, carried: list, items: Column, position: str, value: str) -> DataFrame:
    """Inner explode that evaluates ``items`` once.

    Below an inner explode the optimizer adds a test that the array is not empty and pushes it down with the whole
    expression in it, so a costly expression would run up to three times per row. An outer explode gets no such
    test, and the rows it adds are dropped by position.
    """
    rows = df.select(*carried, F.posexplode_outer(items).alias(position, value))
    return rows.filter(F.col(position).isNotNull())


#: Least number of tasks for each core that rows are dealt to, and rows that a task gets at most, see ``spread``.
TASKS_PER_CORE = 2
ROWS_PER_TASK = 20_000


def spread(rows: DataFrame) -> DataFrame:
    """Short rows that cost much work each, dealt evenly to tasks for all cores, in turn and not by a key.

    A file is split where it has groups of rows, so a table of short rows comes in few tasks, or in one. ``rows`` are those
    of a scan; a scan of more tasks than cores keeps their number. Cores are those of the executors that have come by now,
    so the number of rows, which a scan of columnar files counts without reading them, asks for tasks too.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    by_rows = -(-rows.count() // ROWS_PER_TASK)
    return rows.repartition(max(rows.rdd.getNumPartitions(), TASKS_PER_CORE * cores, by_rows))


#: Rows of keys that a broadcast may hold; more are joined by a shuffle.
FEW_ROWS = 200_000


def listed(keys: DataFrame) -> DataFrame:
    """Keys computed once, written to the shared folder and counted: marked for broadcast up to FEW_ROWS."""
    kept = cut_lineage(keys)
    return F.broadcast(kept) if kept.count() <= FEW_ROWS else kept


def join_few(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join of wide rows with a list of keys and small values that is mostly short.

    Up to FEW_ROWS the list is broadcast, so the wide rows stay where they are; a longer list is joined by the engine's
    own choice. The rows are the same either way.
    """
    return rows.join(listed(keys), on, how)


def split_few(rows: DataFrame, flagged: DataFrame, on: list[str], wanted: str) -> DataFrame:
    """Rows of which ``flagged`` (the keys of all rows, none of them null, with a flag ``wanted``) has the flag set.

    Of the keys with and without the flag the shorter list meets the rows, as a semi or an anti join. So it may be
    broadcast where nearly all rows are wanted, too; the rows are the same either way.
    """
    counted = {r[wanted]: r["n"] for r in flagged.groupBy(wanted).agg(F.count(F.lit(1)).alias("n")).collect()}
    few = counted.get(True, 0) <= counted.get(False, 0)
    keys = flagged.where(F.col(wanted) if few else ~F.col(wanted)).select(*on)
    return join_few(rows, keys, on, "left_semi" if few else "left_anti")
