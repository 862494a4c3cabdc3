"""Names nearest to asked names by edit distance, through an index of their pairs of neighbouring characters.

An edit changes at most two of the ``length + 1`` pairs of a name (its ends count as characters). So of any
``2 * radius + 1`` pairs of an asked name one is left in every name within ``radius`` edits, moved by no more places
than edits were made. The rarest pairs are asked for, together with the length of the name they are in.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.ranking import top_k_per_group
from corpusloom.functions.rows import explode_once, listed
from corpusloom.session import cut_lineage

HEAD, TAIL = "\x02", "\x03"
#: Names with one pair and length that meet in one group of the join; more are split by a hash of the name.
BLOCK = 20_000
#: Names of a length that give a first bound on the distance of names which the index does not help.
SPOKESMEN = 32
#: The index is asked up to a radius of this part of a name's length. Beyond it most pairs would have to be asked for.
USEFUL = 4

_WHERE = ["_pair", "_len"]


def _pairs(name: Column) -> Column:
    padded = F.concat(F.lit(HEAD), name, F.lit(TAIL))
    return F.transform(
        F.sequence(F.lit(1), F.length(name) + 1),
        lambda at: F.struct(at.alias("_at"), F.substring(padded, at, F.lit(2)).alias("_pair")),
    )


class NameIndex:
    """Pairs of distinct names with their places.

    ``known`` has a row for each ``_name`` with ``_first``, what settles ties, and ``_n``, how many rows it stands for. Every name also has
    the empty pair at place 0, by which all names of a length are found.
    """

    def __init__(self, known: DataFrame, block: int = BLOCK):
        self.known = known.withColumn("_len", F.length("_name"))
        whole = F.array(F.struct(F.lit(0).alias("_at"), F.lit("").alias("_pair")))
        places = explode_once(
            self.known, ["_name", "_first", "_n", "_len"], F.concat(whole, _pairs(F.col("_name"))), "_i", "_place"
        ).select("_name", "_first", "_n", "_len", "_place.*")
        self.counts = cut_lineage(places.groupBy(*_WHERE).agg(F.count(F.lit(1)).alias("_count")))
        crowded = self.counts.where(F.col("_count") > block)
        self.blocks = listed(crowded.select(*_WHERE, F.ceil(F.col("_count") / block).cast("int").alias("_blocks")))
        self.places = (
            places.join(self.blocks, _WHERE, "left")
            .withColumn("_block", F.pmod(F.xxhash64("_name"), F.coalesce("_blocks", F.lit(1))).cast("int"))
            .drop("_blocks")
        )

    def rarest(self, asked: DataFrame) -> DataFrame:
        """Pairs of each ``_asked`` name with ``_rank``, from 1 for the rarest among the names known."""
        pairs = explode_once(asked, ["_asked"], _pairs(F.col("_asked")), "_i", "_place").select("_asked", "_place.*")
        common = self.counts.groupBy("_pair").agg(F.sum("_count").alias("_count"))
        order = F.array_sort(F.collect_list(F.struct(F.coalesce("_count", F.lit(0)).alias("_count"), "_at", "_pair")))
        ranked = pairs.join(common, "_pair", "left").groupBy("_asked").agg(order.alias("_order"))
        return ranked.select("_asked", F.posexplode("_order").alias("_rank", "_p")).select(
            "_asked", (F.col("_rank") + 1).alias("_rank"), F.col("_p._at").alias("_asked_at"), "_p._pair"
        )

    def candidates(self, probes: DataFrame) -> DataFrame:
        """Names that have the pair of a probe (_asked, _limit, _asked_at, _pair, _len) at a place within its limit.

        Edits before a pair move it, those behind it make up the rest of the difference in length; both count.
        """
        spread = probes.join(self.blocks, _WHERE, "left").withColumn(
            "_block", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1))
        )
        moved = F.col("_at") - F.col("_asked_at")
        behind = F.col("_len") - F.length("_asked") - moved
        return self.places.join(listed(spread.drop("_blocks")), [*_WHERE, "_block"]).where(
            F.abs(moved) + F.abs(behind) <= F.col("_limit")
        )

    def probes_within(self, asked: DataFrame, rarest: DataFrame) -> DataFrame:
        """Probes for the rarest pairs of names ``asked`` (_asked, _limit), one for each length a name may have."""
        size = F.length("_asked")
        return (
            asked.join(rarest, "_asked")
            .where(F.col("_rank") <= 2 * F.col("_limit") + 1)
            .withColumn(
                "_len", F.explode(F.sequence(F.greatest(size - F.col("_limit"), F.lit(0)), size + F.col("_limit")))
            )
            .drop("_rank")
        )

    def probes_by_length(self, asked: DataFrame, k: int) -> DataFrame:
        """Probes that find all names of the lengths which may hold one of the k nearest.

        Some names of the lengths next to the asked one bound the k-th distance, and with it the lengths.
        """
        few = top_k_per_group(
            self.known, ["_len"], [F.xxhash64("_name"), F.col("_name")], max(SPOKESMEN, k), ["_name"], "_r"
        )
        per_length = few.groupBy("_len").agg(F.count(F.lit(1)).alias("_few"))
        lengths = per_length.agg(F.array_sort(F.collect_list(F.struct("_len", "_few"))).alias("_lengths")).withColumn(
            "_one", F.lit(1)
        )
        size = F.length("_asked")
        sized = asked.select("_asked").withColumn("_one", F.lit(1)).join(F.broadcast(lengths), "_one").drop("_one")
        order = F.array_sort(
            F.transform(
                "_lengths", lambda x: F.struct(F.abs(x["_len"] - size).alias("_off"), x["_len"].alias("_len"), x["_few"].alias("_few"))
            )
        )
        # the nearest lengths that together have k names, or all there are
        taken = F.aggregate(
            order,
            F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<int>").alias("lens")),
            lambda acc, x: F.when(acc["sum"] >= k, acc).otherwise(
                F.struct((acc["sum"] + x["_few"]).alias("sum"), F.concat(acc["lens"], F.array(x["_len"])).alias("lens"))
            ),
        )
        near = sized.select("_asked", "_lengths", F.explode(taken["lens"]).alias("_len")).join(few, "_len")
        measured = near.withColumn("_d", F.levenshtein("_asked", "_name"))
        # k distances of a few dozen names; sums of _n aren't needed, as each name stands for one row or more
        bound = measured.groupBy("_asked").agg(
            F.array_sort(F.collect_list("_d")).alias("_all"), F.first("_lengths").alias("_lengths")
        )
        longest = F.aggregate("_lengths", F.lit(0), lambda acc, x: F.greatest(acc, x["_len"]))
        limit = F.coalesce(F.get("_all", F.lit(k - 1)), F.greatest(size, longest))
        return bound.withColumn("_limit", limit).select(
            "_asked",
            "_limit",
            F.lit(0).alias("_asked_at"),
            F.lit("").alias("_pair"),
            F.explode(
                F.filter(
                    F.transform("_lengths", lambda x: x["_len"]), lambda n: F.abs(n - size) <= F.col("_limit")
                )
            ).alias("_len"),
        )


def _nearest(candidates: DataFrame, k: int) -> DataFrame:
    near = (
        candidates.withColumn("distance", F.call_function("levenshtein", F.col("_name"), F.col("_asked"), F.col("_limit")))
        .where(F.col("distance") >= 0)
        .select("_asked", "_name", "_first", "_n", "distance")
        .distinct()
    )
    return top_k_per_group(near, ["_asked"], [F.col("distance"), F.col("_first")], k, ["_name"], "_r").drop("_r")


def nearest_names(known: DataFrame, asked: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """The k nearest of the ``known`` names (_name, _first, _n) for each ``_asked`` one, as (_asked, _name, distance).

    Ties go to the smaller ``_first``. The radius grows fourfold from 1 to a fourth of a name's length; a name that has k rows within
    it is done, as all names within the radius are found. Names that are not done are compared with all names of the
    lengths in question, in blocks, up to the distance that some of these have. A null asked name has no answer.
    """
    index = NameIndex(known, block)
    todo = cut_lineage(asked.select("_asked").where(F.col("_asked").isNotNull()).distinct())
    rarest = cut_lineage(index.rarest(todo))
    useful = F.floor(F.length("_asked") / USEFUL).cast("int")
    found = None
    done, radius = 0, 1
    while not todo.where(useful > done).isEmpty():
        now = todo.where(useful > done).withColumn("_limit", F.least(F.lit(radius), useful))
        near = cut_lineage(_nearest(index.candidates(index.probes_within(now, rarest)), k))
        whole = near.groupBy("_asked").agg(F.sum("_n").alias("_sum")).where(F.col("_sum") >= k).select("_asked")
        answered = near.join(whole, "_asked", "left_semi")
        found = answered if found is None else found.unionByName(answered)
        todo = cut_lineage(todo.join(whole, "_asked", "left_anti"))
        done, radius = radius, 4 * radius
    rest = _nearest(index.candidates(index.probes_by_length(todo, k)), k)
    return (rest if found is None else found.unionByName(rest)).select("_asked", "_name", "distance")
