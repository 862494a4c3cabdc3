"""Fuzzy name search and context building."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.ranking import top_k_per_group
from corpusloom.functions.rows import join_few
from corpusloom.operators.files import to_search_json
from corpusloom.operators.near_names import nearest_names
from corpusloom.session import cut_lineage

CONTEXT_TOKENS = 1800  # fixed value: token budget of a context
CONTEXT_ROW_COST = 4  # fixed value: what each packed row costs beside its tokens
CONTEXT_SEPARATOR = "\n\n###\n\n"  # fixed value
NOT_FOUND = "Not found."  # fixed value


def full_name(class_name: Column, function_name: Column) -> Column:
    return F.concat(F.coalesce(class_name, F.lit("")), F.coalesce(function_name, F.lit("")))


def find_function_match(
    index: DataFrame,
    function_name: str | None,
    class_name: str | None = None,
    k: int = 3,
    key: str = "block_id",
    named_only: bool = False,
) -> DataFrame:
    """rows whose class and function name are closest to the asked name by edit distance; ties by key."""
    asked = (class_name or "") + (function_name or "")
    name = full_name(F.col("class_name"), F.col("function_name"))
    rows = index.filter(name != "") if named_only else index
    return rows.withColumn("distance", F.levenshtein(name, F.lit(asked))).orderBy("distance", key).limit(k)


def find_function_match_batch(
    index: DataFrame, requests: DataFrame, k: int = 3, key: str = "block_id", request: str = "asked"
) -> DataFrame:
    """F3 for a table of names as (asked, key, distance, rank).

    Equal names are compared once: a name keeps its k smallest keys, which is all a result can need.
    """
    names = index.select(full_name(F.col("class_name"), F.col("function_name")).alias("_name"), key)
    few = top_k_per_group(names, ["_name"], [F.col(key)], k, [key], "_i")
    known = cut_lineage(
        few.groupBy("_name").agg(F.array_sort(F.collect_list(key)).alias("_keys")).withColumn("_first", F.get("_keys", F.lit(0)))
    )
    near = nearest_names(
        known.select("_name", "_first", F.size("_keys").alias("_n")), requests.select(F.col(request).alias("_asked")), k
    )
    keyed = join_few(known.select("_name", "_keys"), near, ["_name"]).select(
        F.col("_asked").alias(request), "distance", F.explode("_keys").alias(key)
    )
    final = Window.partitionBy(request).orderBy("distance", key)
    return (
        keyed.withColumn("rank", F.row_number().over(final))
        .filter(F.col("rank") <= k)
        .select(request, key, "distance", "rank")
    )


def best_match_code(index: DataFrame, function_name: str, class_name: str | None = None) -> DataFrame:
    """code of the closest row."""
    return find_function_match(index, function_name, class_name, 1).select("code")


def view_function_code(index: DataFrame, requests: DataFrame, k: int = 3, key: str = "block_id") -> DataFrame:
    """JSON records of the code of the closest rows per asked name, or a message when there are none."""
    hits = find_function_match_batch(index, requests, k, key)
    coded = join_few(index.select(key, "code"), hits, [key])
    records = to_search_json(coded, ("code",), keep=("asked", "rank"))
    packed = records.groupBy("asked").agg(
        F.concat(
            F.lit("["),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("rank", "record"))), lambda r: r["record"]), ", "
            ),
            F.lit("]"),
        ).alias("answer")
    )
    return (
        requests.select("asked")
        .distinct()
        .join(packed, "asked", "left")
        .withColumn("answer", F.coalesce("answer", F.lit(NOT_FOUND)))
    )


def qa_context(
    hits: DataFrame, index: DataFrame, key: str = "block_id", query_key: str = "query_id", text: str = "code"
) -> DataFrame:
    """the codes of each question's hits, best first, joined by newline."""
    coded = join_few(index.select(key, text), hits.select(query_key, "rank", key), [key])
    return coded.groupBy(query_key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", text))), lambda r: r[text]), "\n"
        ).alias("context")
    )


def pack_context(
    ranked: DataFrame,
    query_key: str = "query_id",
    key: str = "doc_id",
    text: str = "text",
    distance: str = "distances",
    max_len: int = CONTEXT_TOKENS,
) -> DataFrame:
    """F8: nearest rows of each query while their running cost stays within the budget, stopping at the first
    overflow.

    A row costs at least its fixed part, so no more than ``max_len / 4`` rows of a query can be kept: that exact
    limit comes first, without the texts, and only the kept rows fetch theirs.
    """
    order = [F.col(distance), F.col(key)]
    cost = ranked.select(query_key, key, distance, (F.col("n_tokens") + CONTEXT_ROW_COST).alias("_cost"))
    few = top_k_per_group(cost, [query_key], order, max_len // CONTEXT_ROW_COST, [key])
    upto = Window.partitionBy(query_key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    kept = few.withColumn("cur_len", F.sum("_cost").over(upto)).filter(F.col("cur_len") <= max_len)
    texts = ranked.select(query_key, key, text)
    return join_few(texts, kept.select(query_key, key, "rank", "cur_len"), [query_key, key]).groupBy(query_key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", text))), lambda r: r[text]),
            CONTEXT_SEPARATOR,
        ).alias("context"),
        F.count("*").alias("n_rows"),
        F.max("cur_len").alias("cur_len"),
    )
