"""Embedding, chunk averaging and exact vector search."""

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import bind, tokens
from corpusloom.functions.vectors import cosine_distance, dot, norm, vector_literal
from corpusloom.operators.tokens import CHUNK_TOKENS

DEFAULT_K = 3  # fixed value: rows a search returns
BLOCK_ROWS = 8192  # vectors of a block on either side of a batch search
SCORE_CELLS = 1 << 22  # scores a task holds at a time


class HashingModel:
    """Deterministic default model: one dimension per token hash bucket, counted."""

    takes_arrow = True  # gets the chunks as an Arrow array of token lists instead of Python lists

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, chunks: pa.ListArray) -> np.ndarray:
        words = chunks.flatten().dictionary_encode()
        slots = np.array(
            [int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % self.dim for w in words.dictionary.to_pylist()],
            dtype=np.int64,
        )
        rows = np.repeat(np.arange(len(chunks)), np.asarray(chunks.value_lengths()))
        cells = rows * self.dim + slots[np.asarray(words.indices)]
        counts = np.bincount(cells, minlength=len(chunks) * self.dim).reshape(len(chunks), self.dim).astype(float)
        return counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-300)


def _weighted_unit_mean(vectors: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sums = np.add.reduceat(vectors * sizes[:, None], starts, axis=0)
    return sums / np.linalg.norm(sums, axis=1, keepdims=True)


def _embedder(model: Callable[..., np.ndarray]):
    """Arrow function from the chunks of each text to its vector."""

    def means(vectors: np.ndarray, sizes: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum(per_text)[:-1]]).astype(int)
        return _weighted_unit_mean(np.asarray(vectors, dtype=float), sizes, starts).astype(np.float32)

    def on_arrow(chunks: pa.ListArray) -> pa.Array:
        per_row = np.asarray(pc.fill_null(chunks.value_lengths(), 0))
        filled = np.flatnonzero(per_row)
        if len(filled) == 0:
            return pa.nulls(len(chunks), pa.list_(pa.float32()))
        flat = chunks.flatten()
        found = means(model(flat), np.asarray(flat.value_lengths(), dtype=float), per_row[filled])
        place = np.full(len(chunks), -1)
        place[filled] = np.arange(len(filled))
        rows = pa.FixedSizeListArray.from_arrays(pa.array(found.reshape(-1)), found.shape[1])
        picks = pa.array(place, mask=place < 0)
        return rows.cast(pa.list_(pa.float32())).take(picks)

    def on_lists(chunks: pa.ListArray) -> pa.Array:
        place: dict[tuple, int] = {}  # equal texts of a batch are embedded once
        texts: list[list[list[str]]] = []
        slots: list[int | None] = []
        for item in chunks.to_pylist():
            mark = tuple(map(tuple, item)) if item else None
            if mark is not None and mark not in place:
                place[mark] = len(texts)
                texts.append(item)
            slots.append(None if mark is None else place[mark])
        if not texts:
            return pa.nulls(len(chunks), pa.list_(pa.float32()))
        flat = [chunk for item in texts for chunk in item]
        sizes = np.array([len(chunk) for chunk in flat], dtype=float)
        found = means(model(flat), sizes, np.array([len(item) for item in texts]))
        return pa.array([None if s is None else found[s] for s in slots], type=pa.list_(pa.float32()))

    return on_arrow if getattr(model, "takes_arrow", False) else on_lists


def embed(
    df: DataFrame,
    text: str = "code",
    model: Callable[..., np.ndarray] | None = None,
    out: str = "code_embedding",
    chunk_tokens: int = CHUNK_TOKENS,
    once_per_text: bool = False,
) -> DataFrame:
    """Unit vector per row; NULL where the text has no tokens.

    ``model`` maps a list of token lists to a matrix with one row per list.

    A text longer than one request is embedded chunk by chunk and averaged in the same task. By default this is one
    pass without a shuffle. With ``once_per_text``, for models that cost
    more than a shuffle, every distinct text of the table is embedded once and joined back; ``df`` is then read
    twice, so it should be a stored table.
    """

    def cut(toks: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.greatest(F.size(toks) - 1, F.lit(0)), F.lit(chunk_tokens)),
            lambda i: i < F.size(toks),
        )
        return F.transform(starts, lambda i: F.slice(toks, i + 1, F.lit(chunk_tokens)))

    run = _embedder(model or HashingModel())

    def add_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the chunks come last and are replaced by the vectors; other columns pass through untouched
        for batch in batches:
            kept = batch.num_columns - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], run(batch.column(kept))], names=[*batch.schema.names[:kept], out]
            )

    def with_vectors(rows: DataFrame, source: str) -> DataFrame:
        chunked = rows.withColumn("_chunks", bind(tokens(F.col(source)), cut))
        fields = [f for f in rows.schema.fields if f.name != out]
        schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.FloatType()))])
        return chunked.select(*[f.name for f in fields], "_chunks").mapInArrow(add_vectors, schema)

    if not once_per_text:
        return with_vectors(df, text)
    keyed = df.withColumn("_key", F.md5(F.col(text)))
    once = keyed.filter(F.col(text).isNotNull()).groupBy("_key").agg(F.any_value(F.col(text)).alias("_text"))
    vectors = with_vectors(once, "_text").drop("_text")
    return keyed.join(vectors, "_key", "left").drop("_key")


def combine_chunk_embeddings(
    chunks: DataFrame, keys: list[str], vector: str = "embedding", weight: str = "n_tokens"
) -> DataFrame:
    """Mean of the chunk vectors weighted by chunk length, scaled to unit length.

    Sums per dimension combine before the shuffle, so a block with very many chunks stays cheap.
    """
    cells = chunks.select(
        *keys, F.col(weight).cast("double").alias("_w"), F.posexplode(vector).alias("_dim", "_x")
    )
    sums = cells.groupBy(*keys, "_dim").agg(
        (F.sum(F.col("_w") * F.col("_x").cast("double")) / F.sum("_w")).alias("_mean")
    )
    rows = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_dim", "_mean"))).alias("_cells"))
    means = rows.select(*keys, F.transform("_cells", lambda c: c["_mean"]).alias("_means"))
    return means.select(
        *keys,
        bind(
            F.struct(F.col("_means").alias("m"), norm(F.col("_means")).alias("n")),
            lambda v: F.transform(v["m"], lambda x: x / v["n"]),
        ).alias(vector),
    )


def semantic_search(
    index: DataFrame,
    query: Sequence[float],
    k: int = DEFAULT_K,
    key: str = "block_id",
    vector: str = "code_embedding",
) -> DataFrame:
    """dot product with the query, best first; ties by key. Rows without a vector are left out."""
    scored = index.filter(F.col(vector).isNotNull()).withColumn(
        "similarities", dot(F.col(vector), vector_literal(query))
    )
    return scored.orderBy(F.desc("similarities"), key).limit(k)


def _best_columns(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores per row; among equal scores the leftmost columns win."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    picks = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    floor = np.take_along_axis(scores, picks, axis=1).min(axis=1)
    tied = np.flatnonzero((scores >= floor[:, None]).sum(axis=1) > k)
    for row in tied:
        columns = np.flatnonzero(scores[row] >= floor[row])
        picks[row] = columns[np.argsort(-scores[row, columns], kind="stable")[:k]]
    return picks


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = pc.list_flatten(vectors).to_numpy().astype(np.float64)
    return flat.reshape(len(vectors), -1)


def _best_of_blocks(k: int, names: list[str]):
    """Arrow function from a block of index rows and one of queries to the best k rows for each query."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, keys = asked.column("query_id"), rows.column("key")
        if not len(rows) or not len(asked):
            return pa.table([ids.slice(0, 0), keys.slice(0, 0), pa.array([], pa.float64())], names=names)
        # Equal scores are settled by key: rows come in the order of their keys.
        order = pc.sort_indices(rows, sort_keys=[("key", "ascending")], null_placement="at_start")
        keys, queries = keys.take(order), _matrix(asked.column("vector"))
        matrix = _matrix(rows.column("vector").take(order)).T
        step, found = max(1, SCORE_CELLS // len(rows)), []
        for at in range(0, len(asked), step):
            scores = queries[at : at + step] @ matrix
            picks = _best_columns(scores, k)
            of = np.repeat(np.arange(at, at + len(scores)), picks.shape[1])
            best = np.take_along_axis(scores, picks, axis=1).reshape(-1)
            found.append(pa.table([ids.take(pa.array(of)), keys.take(pa.array(picks.reshape(-1))), pa.array(best)], names=names))
        return pa.concat_tables(found)

    return run


def _in_blocks(rows: DataFrame, sizes: DataFrame, own: str, other: str) -> DataFrame:
    """``rows`` (key or query_id, vector) with the number ``own`` of a block, once for each block ``other`` of the other side.
    ``sizes`` is one row with the number of blocks of both sides."""
    counted = rows.crossJoin(F.broadcast(sizes))
    return counted.select(
        *rows.columns,
        F.pmod(F.xxhash64(*rows.columns), F.col(f"n{own}")).cast("int").alias(own),
        F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1)).alias(other),
    )


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    return rows.agg(F.greatest(F.ceil(F.count(F.lit(1)) / size), F.lit(1)).cast("int").alias(name))


def semantic_search_batch(
    index: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_K,
    key: str = "block_id",
    vector: str = "code_embedding",
    query_key: str = "query_id",
    query_vector: str = "query_embedding",
    query_block: int = BLOCK_ROWS,
    index_block: int = BLOCK_ROWS,
) -> DataFrame:
    """best k rows for every query as (query_key, key, similarities, rank); ties by key. Rows and queries without a
    vector are left out; query keys are unique.

    A join of blocks. Rows and queries are dealt into blocks by a hash of key and vector; every row is sent once for each
    block of queries, and every query once for each block of rows. So a side that fits one block leaves the other where it
    would be in a plain shuffle. A pair of blocks is multiplied in one task, which holds both and some of their scores;
    the shuffle behind it carries k rows per query and block of rows.
    """
    rows = index.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    asked = queries.filter(F.col(query_vector).isNotNull()).select(
        F.col(query_key).alias("query_id"), F.col(query_vector).alias("vector")
    )
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema[query_key].dataType),
            T.StructField("key", index.schema[key].dataType),
            T.StructField("similarities", T.DoubleType()),
        ]
    )
    sizes = _blocks(rows, index_block, "n_rows").crossJoin(_blocks(asked, query_block, "n_asked"))  # one row, in the plan
    dealt = _in_blocks(rows, sizes, "_rows", "_asked").groupBy("_rows", "_asked")
    questions = _in_blocks(asked, sizes, "_asked", "_rows").groupBy("_rows", "_asked")
    found = dealt.cogroup(questions).applyInArrow(_best_of_blocks(k, schema.names), schema)
    first = Window.partitionBy("query_id").orderBy(F.desc("similarities"), "key")
    best = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return best.select(F.col("query_id").alias(query_key), F.col("key").alias(key), "similarities", "rank")


def rank_by_cosine(
    df: DataFrame, query: Sequence[float], vector: str = "embedding", out: str = "distances"
) -> DataFrame:
    """cosine distance to the query as a column; order by it where an order is needed."""
    return df.filter(F.col(vector).isNotNull()).withColumn(
        out, cosine_distance(F.col(vector), vector_literal(query))
    )
