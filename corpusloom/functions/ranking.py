"""Top-k and running sums that hold when one group has most of the rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 256


def top_k_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, spread: list[str], rank: str = "rank"
) -> DataFrame:
    """First k rows of each group with their rank.

    A group is first cut by the task its rows come from and limited to k rows per cut. So a task sends at most k rows
    of a group, and the last step sees at most k x SALTS rows of any group, however large the group is. ``order`` must
    settle all ties; ``spread`` names the columns that do.
    """
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    few = salted.withColumn("_rank", F.row_number().over(inner)).filter(F.col("_rank") <= k)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return (
        few.drop("_rank", "_salt").withColumn(rank, F.row_number().over(outer)).filter(F.col(rank) <= k)
    )


def running_sum(df: DataFrame, key: str, turn: str, value: str, out: str, span: int = 4096) -> DataFrame:
    """Sum of ``value`` up to and including each row of its group, in order of the integer ``turn``.

    Turns are unique within a group, so a segment of ``span`` turns holds at most ``span`` rows. Segment totals
    are summed over the much smaller table of segments and added to the sums within segments.
    """
    cut = df.withColumn("_segment", F.floor(F.col(turn) / span))
    totals = cut.groupBy(key, "_segment").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(key).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, "_segment", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(key, "_segment").orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.withColumn("_within", F.sum(value).over(within))
        .join(offsets, [key, "_segment"])
        .withColumn(out, F.col("_within") + F.col("_offset"))
        .drop("_segment", "_within", "_offset")
    )
