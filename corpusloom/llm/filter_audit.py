"""What each of several filters does in every order of them, per part of a corpus.

Documents become cells: a part and the mask of the filters that they fail, with counts. Every cell folds over all orders
of the filters; the folds' steps are summed element by element. Only counts are folded, so this costs the same for any
number of documents.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.registry import query, table

STEP = "bit:int,kept:bigint,removed:bigint,redundant:bigint,unique_fails:bigint,good_lost:bigint,toxic_lost:bigint"
COUNTS = [c.split(":")[0] for c in STEP.split(",")][1:]
#: Values over which rows without id are spread in joins by id.
SPREAD = 1024


def words(text: Column) -> Column:
    """Longest runs of signs other than space and 0x09 to 0x0D."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _ids_spread(doc_id: Column, other: Column) -> Column:
    """0 for an id; rows without one are spread by ``other``, as they match nothing."""
    return F.when(doc_id.isNull(), F.pmod(F.xxhash64(other), F.lit(SPREAD))).otherwise(F.lit(0))


def mask_cells(
    docs: DataFrame, labels: DataFrame, filters: dict[str, Column | None], doc_id: str = "doc_id", text: str = "text",
    part: str = "source",
) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters that they fail, those labelled quality 1 and toxic 1.

    Bit k of the mask is the k-th of ``filters``, which hold failure conditions over a column ``text``, null counting as
    passed; None stands for the filter of copies: a text that a row of smaller id has too.

    The shuffles carry digests, ids and masks, never texts. Copies are counted within tasks first, so a text that a third
    of the rows have costs a row for each task once their ids have been told apart.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    bits = [F.coalesce(c, F.lit(False)).cast("int") * (1 << k) for k, c in enumerate(filters.values()) if c is not None]
    copies = sum(1 << k for k, c in enumerate(filters.values()) if c is None)
    masked = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits, F.lit(0)).alias("mask"))
    once = masked.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(
            F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
        )
        .withColumn("spread", F.lit(0).cast("long"))
    )
    marked = once.withColumn("spread", _ids_spread(F.col("doc_id"), F.col("digest")).cast("long")).join(
        marks, ["doc_id", "spread"], "left"
    )
    flags = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    # Within a row of these all ids differ, so ``least`` knows how many rows the least id has.
    alike = marked.groupBy("digest", "part", "mask", *flags).agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    )
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    later = (
        F.when(F.col("first").isNull(), F.lit(0))
        .when(F.col("least.doc_id") == F.col("first"), F.col("n") - F.col("least.n"))
        .otherwise(F.col("n"))
    )
    counted = alike.withColumn("first", first).withColumn("later", later.cast("long") if copies else F.lit(0).cast("long"))
    halves = F.array(
        F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("later")).alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(copies)).alias("mask"), F.col("later").alias("n")),
    )
    return (
        counted.select("part", "good", "toxic", F.explode(halves).alias("half"))
        .where("half.n > 0")
        .groupBy("part", F.col("half.mask").alias("mask"))
        .agg(
            F.sum("half.n").alias("n"),
            F.sum(F.col("half.n") * F.col("good")).alias("good"),
            F.sum(F.col("half.n") * F.col("toxic")).alias("toxic"),
        )
    )


def fold_orders(cell: Column, orders: Column) -> Column:
    """The steps of all orders, one order after the other, as one cell of documents goes through them.

    ``orders`` is an array of arrays of filter bits.
    """
    mask = cell["mask"]

    def step(state: Column, bit: Column) -> Column:
        fails = mask.bitwiseAND(bit) != 0
        gone = mask.bitwiseAND(state["before"]) != 0
        removed = fails & ~gone
        count = lambda of, when: F.when(when, cell[of]).otherwise(F.lit(0).cast("long"))
        made = F.struct(
            bit.alias("bit"),
            count("n", ~fails & ~gone).alias("kept"),
            count("n", removed).alias("removed"),
            count("n", fails & gone).alias("redundant"),
            count("n", mask == bit).alias("unique_fails"),
            count("good", removed).alias("good_lost"),
            count("toxic", removed).alias("toxic_lost"),
        )
        return F.struct(
            state["before"].bitwiseOR(bit).alias("before"), F.concat(state["steps"], F.array(made)).alias("steps")
        )

    start = F.struct(F.lit(0).alias("before"), F.array().cast(f"array<struct<{STEP}>>").alias("steps"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda s: s["steps"])))


def _sum_steps(cells: Column, orders: Column, steps: int) -> Column:
    """Element by element, the sums of the folds of some cells."""
    zero = F.struct(*[F.lit(0).cast("int" if c == "bit" else "long").alias(c) for c in ["bit", *COUNTS]])

    def add(a: Column, b: Column) -> Column:
        return F.struct(b["bit"].alias("bit"), *[(a[c] + b[c]).alias(c) for c in COUNTS])

    return F.aggregate(
        cells, F.array_repeat(zero, steps), lambda total, cell: F.zip_with(total, fold_orders(cell, orders), add)
    )


def audit_filters(
    docs: DataFrame, labels: DataFrame, filters: dict[str, Column | None], doc_id: str = "doc_id", text: str = "text",
    part: str = "source",
) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.

    ``filters`` names each filter by one sign and gives its failure condition, see ``mask_cells``; there are as many orders
    as permutations, so no more than six filters are taken. Counts are of documents of the part: ``kept`` after the step,
    ``removed`` by it, ``redundant`` fail its filter but are gone before, ``unique_fails`` fail its filter only,
    ``good_lost`` and ``toxic_lost`` are removed ones with labels quality 1 and toxic 1, and ``shapley`` is what the
    filter removes summed over all orders, at whichever step.

    A null part is the empty one, a null text an empty text. A row without id follows all others: it is a copy if any row
    with an id has its text; it has no label. Rows of the same id and text are no copies of each other. Labels of one id
    count once, the greater of several. An empty table gives no rows. Other columns are ignored.
    """
    if not 1 <= len(filters) <= 6 or any(len(name) != 1 for name in filters):
        raise ValueError("one to six filters, each named by one sign")
    names = list(filters)
    ways = list(permutations(range(len(names))))
    orders = F.array(*[F.array(*[F.lit(1 << k) for k in way]) for way in ways])
    spelled = F.array(*[F.lit("".join(names[k] for k in way)) for way in ways])
    cells = mask_cells(docs, labels, filters, doc_id, text, part)
    summed = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")).select(
        "part", _sum_steps(F.col("cells"), orders, len(ways) * len(names)).alias("steps")
    )
    share = F.transform(
        F.array(*[F.lit(1 << k) for k in range(len(names))]),
        lambda bit: F.aggregate(
            "steps", F.lit(0).cast("long"), lambda a, s: a + F.when(s["bit"] == bit, s["removed"]).otherwise(F.lit(0))
        ),
    )
    each = summed.withColumn("shares", share).select("part", "shares", F.posexplode("steps").alias("at", "made"))
    return each.select(
        "part",
        F.element_at(spelled, (F.floor(F.col("at") / len(names)) + 1).cast("int")).alias("filter_order"),
        (F.col("at") % len(names) + 1).cast("int").alias("step"),
        *[F.col("made")[c].alias(c) for c in COUNTS],
        F.element_at("shares", F.bit_count(F.col("made.bit") - 1) + 1).alias("shapley"),
    )


def audited_filters() -> dict[str, Column | None]:
    """The filters of the registered query."""
    text = F.col("text")
    found = words(text)
    return {
        "A": F.size(found) < 50,
        "B": F.size(F.array_distinct(found)) * 100 < F.size(found) * 65,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * 5,
        "D": text.rlike("[#$%&*|]"),
        "E": None,
    }


SQL = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents
), m as (
  select part, len(w) < 50 as a, 100 * len(list_distinct(w)) < 65 * len(w) as b,
    100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) as c,
    regexp_matches(t, '[#$%&*|]') as dd, doc_id > min(doc_id) over (partition by t) as e,
    coalesce(l.quality = 1, false) as good, coalesce(l.toxic = 1, false) as toxic
  from d left join labels l using (doc_id)
), cells as (
  select part, a::int + 2 * b::int + 4 * c::int + 8 * dd::int + 16 * e::int as mask, count(*) as n,
    count(*) filter (good) as good, count(*) filter (toxic) as toxic
  from m group by all
), f as (select unnest(['A', 'B', 'C', 'D', 'E']) as name, unnest([1, 2, 4, 8, 16]) as bit),
orders as (
  select f1.name || f2.name || f3.name || f4.name || f5.name as filter_order,
    unnest([1, 2, 3, 4, 5]) as step,
    unnest([f1.bit, f2.bit, f3.bit, f4.bit, f5.bit]) as bit,
    unnest([0, f1.bit, f1.bit + f2.bit, f1.bit + f2.bit + f3.bit, f1.bit + f2.bit + f3.bit + f4.bit]) as before
  from f f1, f f2, f f3, f f4, f f5
  where f1.bit + f2.bit + f3.bit + f4.bit + f5.bit = 31
    and f1.bit | f2.bit | f3.bit | f4.bit | f5.bit = 31
), steps as (
  select part, filter_order, step, bit,
    sum(case when mask & (before | bit) = 0 then n else 0 end)::bigint as kept,
    sum(case when mask & before = 0 and mask & bit > 0 then n else 0 end)::bigint as removed,
    sum(case when mask & before > 0 and mask & bit > 0 then n else 0 end)::bigint as redundant,
    sum(case when mask = bit then n else 0 end)::bigint as unique_fails,
    sum(case when mask & before = 0 and mask & bit > 0 then good else 0 end)::bigint as good_lost,
    sum(case when mask & before = 0 and mask & bit > 0 then toxic else 0 end)::bigint as toxic_lost
  from cells, orders group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, bit))::bigint as shapley
from steps
"""


@query(SQL)
def op11_filter_audit(spark, sf_dir):
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), audited_filters())
