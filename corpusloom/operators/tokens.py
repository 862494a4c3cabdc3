"""Token counts, chunks and histograms."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.rows import explode_once
from corpusloom.functions.text import bind, count_tokens, tokens

CHUNK_TOKENS = 8191  # fixed value: tokens per embedding request

# fixed values: models and what a message and a name cost on top of their tokens
EXACT_MODELS = {
    "gpt-3.5-turbo-0613": (3, 1),
    "gpt-3.5-turbo-16k-0613": (3, 1),
    "gpt-4-0314": (3, 1),
    "gpt-4-32k-0314": (3, 1),
    "gpt-4-0613": (3, 1),
    "gpt-4-32k-0613": (3, 1),
    "gpt-3.5-turbo-0125": (3, 1),
    "gpt-4o-mini-2024-07-18": (3, 1),
    "gpt-4o-2024-08-06": (3, 1),
    "gpt-4.1-mini": (3, 1),
    "gpt-3.5-turbo-0301": (4, -1),
}
FAMILIES = ("gpt-4.1-mini", "gpt-4o-mini", "gpt-4o", "gpt-4")  # a name holding one of these costs (3, 1)
REPLY_COST = 3  # fixed value: every conversation primes one reply


def n_tokens(docs: DataFrame, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Tokens per row."""
    return docs.withColumn(out, count_tokens(F.col(text)))


def bpe_counter(model: str = "gpt-4", fallback: str = "cl100k_base"):
    """E1 with byte-pair tokens: a pandas UDF; its vocabulary must be reachable from the executors."""
    import pandas as pd

    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        import tiktoken

        try:
            encoding = tiktoken.encoding_for_model(model)
        except KeyError:
            encoding = tiktoken.get_encoding(fallback)
        return texts.map(lambda t: None if t is None else len(encoding.encode(t)))

    return counted


def token_chunks(docs: DataFrame, n: int = CHUNK_TOKENS, text: str = "text") -> DataFrame:
    """Consecutive runs of n tokens, the last one shorter; an empty text has none."""
    if n < 1:
        raise ValueError("n must be at least one")
    carried = [c for c in docs.columns if c != text]

    def cut(toks: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.greatest(F.size(toks) - 1, F.lit(0)), F.lit(n)), lambda i: i < F.size(toks)
        )
        return F.transform(starts, lambda i: F.slice(toks, i + 1, F.lit(n)))

    chunks = explode_once(docs, carried, bind(tokens(F.col(text)), cut), "chunk", "tokens")
    return chunks.withColumn("n_tokens", F.size("tokens"))


def model_overheads(spark: SparkSession) -> DataFrame:
    rows = [(name, *cost) for name, cost in EXACT_MODELS.items()]
    return spark.createDataFrame(rows, "model string, per_message int, per_name int")


def message_overhead(model: Column) -> tuple[Column, Column]:
    """Cost per message and per name of a model; an unknown model is an error."""
    known = F.create_map(*[F.lit(x) for name, cost in EXACT_MODELS.items() for x in (name, cost[0])])
    named = F.create_map(*[F.lit(x) for name, cost in EXACT_MODELS.items() for x in (name, cost[1])])
    family = F.lit(False)
    for part in FAMILIES:
        family = family | F.contains(model, F.lit(part))
    problem = F.raise_error(F.concat(F.lit("no token rule for model "), model)).cast("int")
    per_message = F.coalesce(F.try_element_at(known, model), F.when(family, 3).otherwise(problem))
    per_name = F.coalesce(F.try_element_at(named, model), F.when(family, 1).otherwise(problem))
    return per_message, per_name


def quoted_tokens(value: Column) -> Column:
    """Tokens of a value with its JSON quotes."""
    return F.when(value.isNotNull(), count_tokens(value) + 2).otherwise(0)


def message_tokens(fields: list[Column], name: Column | None = None, model: Column | None = None) -> Column:
    """Tokens one message adds to a conversation."""
    per_message, per_name = message_overhead(F.lit("gpt-4") if model is None else model)
    cost = per_message
    for value in fields:
        cost = cost + quoted_tokens(value)
    if name is not None:
        cost = cost + F.when(name.isNotNull(), quoted_tokens(name) + per_name).otherwise(0)
    return cost


def chat_tokens(
    messages: DataFrame,
    fields: tuple[str, ...] = ("role", "text"),
    name: str | None = None,
    model: str = "gpt-4",
    key: str = "conv_id",
) -> DataFrame:
    """E5: tokens per conversation; sums combine before the shuffle."""
    cost = message_tokens(
        [F.col(c) for c in fields], F.col(name) if name else None, F.lit(model)
    )
    return messages.groupBy(key).agg((F.sum(cost) + REPLY_COST).cast("long").alias("n_tokens"))


def token_histogram(docs: DataFrame, bins: int = 10, column: str = "n_tokens") -> DataFrame:
    """Rows per equal-width bin between the smallest and the largest count; the last bin is closed."""
    value = F.col(column)
    limits = docs.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    # one row of limits: broadcast of fixed size
    placed = docs.select(value.alias("v"), F.lit(1).alias("_one")).join(
        F.broadcast(limits.withColumn("_one", F.lit(1))), "_one"
    )
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    slot = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))
    )
    counts = placed.filter(F.col("v").isNotNull()).groupBy(slot.cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    return counts
