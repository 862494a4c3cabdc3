"""Nearest neighbours by largest inner product: inverted lists scanned by adaptive dimensions.

Vectors get one more component that gives all the same length, so that the nearest by distance are those with the largest
inner product, and are rotated at random, so that any few components speak for the whole. A list's rotated vectors lie in
blocks of columns. For a query the scan adds up squared differences block by block; after each, candidates whose partial
distance, scaled up, exceeds the query's threshold by more than a hypothesis test allows are abandoned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.registry import query, small_batches, table
from corpusloom.session import scratch_path

#: Vectors the lists are fitted on, at most; also bounds what the driver and the tasks hold of the index.
SAMPLE = 16_384
#: Rows every query is compared with first, for a threshold and so that no query has fewer than k rows.
KNOWN = 256
#: Vectors of a list, on average, up to the square of it; lists, at most.
LIST_ROWS, MOST_LISTS = 2048, SAMPLE // 16
#: Lists are scanned in bundles: a bundle's bytes, and a block of queries', at most; bundles, at least.
BUNDLE_BYTES, BUNDLES = 32 << 20, 8
#: Columns of a block; pairs of a query and a candidate that are begun at a time; share of pairs, as 1 in so many, below
#: which a block is read for the pairs that are left.
COLUMNS, PAIRS, DENSE = 8, 1 << 20, 16


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector as doubles) of rows with an id whose vector is neither null, empty nor zero, and finite in all parts."""
    x = F.col("vector")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    return (
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
        .where(F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0))
    )


class Index:
    """Rotation, list centres, and what the scan needs to know; of bounded size."""

    def __init__(self, sample: np.ndarray, length: float, lists: int, probes: int | None, k: int, recall: float, seed: int):
        rng = np.random.default_rng(seed)
        self.length = length
        self.dim = sample.shape[1] + 1
        self.rotation = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0]
        placed = self.place(sample)
        self.centres = _centres(placed, lists, rng)
        self.probes = probes or self._calibrate(sample, placed, k, recall, rng)

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """Lengthened and rotated vectors."""
        scaled = vectors / self.length
        more = np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))
        return np.column_stack([scaled, more]) @ self.rotation

    def place_query(self, vectors: np.ndarray) -> np.ndarray:
        """Queries have no further component; their own length doesn't change the order of their neighbours."""
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.column_stack([vectors / norms, np.zeros(len(vectors))]) @ self.rotation

    def nearest_lists(self, placed: np.ndarray, count: int) -> np.ndarray:
        far = _distances(placed, self.centres)
        count = min(count, len(self.centres))
        some = np.argpartition(far, count - 1, axis=1)[:, :count]
        return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1)

    def _calibrate(self, sample: np.ndarray, placed: np.ndarray, k: int, recall: float, rng) -> int:
        """Lists to probe so that queries drawn from the sample find the wanted share of their neighbours in it.

        They are placed as queries are, which is another place than their own as data unless all lengths are equal. The
        sample is sparser than the table, so its neighbours lie further apart and over more lists.
        """
        asked = rng.permutation(len(placed))[:400]
        queries = self.place_query(sample[asked])
        own = self.nearest_lists(placed, 1)[:, 0]
        ranks = np.argsort(np.argsort(_distances(queries, self.centres), axis=1), axis=1)
        far = _distances(queries, placed)
        far[np.arange(len(asked)), asked] = np.inf
        k = min(k, len(placed) - 1)
        if k < 1:
            return len(self.centres)
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        return int(np.quantile(np.take_along_axis(ranks, own[near], 1), recall)) + 1


class Known:
    """Few rows that every query is compared with first: they bound how far its neighbours can be.

    A query keeps its k nearest of them, so that it has k rows even if its probed lists hold fewer.
    """

    def __init__(self, index: Index, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.lexsort((rows, ids))
        self.rows, self.ids, self.vectors = rows[by_id], ids[by_id], vectors[by_id]
        self.placed = index.place(self.vectors)

    def near(self, points: np.ndarray, placed: np.ndarray, query_ids: np.ndarray, k: int):
        """Squared distances within which k neighbours surely are; (query, known row, score) of the known neighbours."""
        scores = exact_scores(self.vectors[None], points[:, None])
        scores[query_ids[:, None] == self.ids[None]] = -np.inf
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # rows lie by id, so ties go to the smaller one
        scores = np.take_along_axis(scores, best, 1)
        real = np.isfinite(scores)
        far = np.take_along_axis(_distances(placed, self.placed), best, 1)
        enough = real.all(axis=1) & (best.shape[1] >= k)
        of, at = np.nonzero(real)
        return np.where(enough, far.max(axis=1, initial=0), np.inf), of, best[of, at], scores[of, at]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T))


def _centres(placed: np.ndarray, lists: int, rng) -> np.ndarray:
    points = np.unique(placed, axis=0)
    centres = points[rng.permutation(len(points))[:lists]]
    for _ in range(8):
        own = _distances(placed, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, placed)
        counts = np.bincount(own, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def adaptive_scan(
    columns: np.ndarray, points: np.ndarray, thresholds: np.ndarray, strictness: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, candidates, squared distances) of the pairs that were not abandoned, by query; ``columns`` is
    (dimensions, candidates).

    After d of D dimensions the distance is estimated as D / d times the partial one. It is further than the query's
    threshold, except with small chance, if it exceeds it by the factor (1 + strictness / sqrt(d)) squared. The last
    block needs no test but the distance itself. While many pairs are left a block is one product of matrices; once
    few are, it is read for these alone.
    """
    dim = len(columns)

    def allowed(upto: int) -> np.ndarray:
        part = 1.0 if upto == dim else (1 + strictness / math.sqrt(upto)) ** 2 * upto / dim
        return thresholds * (1 + 1e-9) * part + 1e-9

    dense = np.zeros((len(points), columns.shape[1]))
    left = np.ones(dense.shape, bool)
    upto = 0
    while upto < dim and np.count_nonzero(left) * DENSE >= left.size:
        at, upto = upto, min(dim, upto + COLUMNS)
        dense += _distances(points[:, at:upto], columns[at:upto].T)
        left &= dense <= allowed(upto)[:, None]
    of, which = np.nonzero(left)
    partial = dense[of, which]
    while upto < dim:
        at, upto = upto, min(dim, upto + COLUMNS)
        for j in range(at, upto):
            step = columns[j, which] - points[of, j]
            partial = partial + step * step
        stay = partial <= allowed(upto)[of]
        of, which, partial = of[stay], which[stay], partial[stay]
    return of, which, partial


def _nearest_of_each(of: np.ndarray, far: np.ndarray, queries: int, k: int) -> np.ndarray:
    """Which pairs lie within the k-th smallest distance of their query; equal distances stay, whatever the rounding."""
    order = np.lexsort((far, of))
    starts = np.searchsorted(of[order], np.arange(queries + 1))
    last = np.full(queries, np.inf)
    full = starts[1:] - starts[:-1] > k
    last[full] = far[order][starts[:-1][full] + k - 1]
    return far <= last[of] + 1e-9


def bundles_of(sizes: dict[int, int], capacity: int) -> dict[int, tuple[int, int]]:
    """First bundle and number of bundles of each list; lists share a bundle as far as it holds them."""
    out, at, room = {}, 0, capacity
    for name, size in sorted(sizes.items()):
        if size > room and room < capacity:
            at, room = at + 1, capacity
        parts = -(-size // capacity)
        out[name] = (at, parts)
        if parts > 1:
            at += parts
        else:
            room -= size
    return out


def scan_lists(
    index: Index, lists: np.ndarray, ids: np.ndarray, own: np.ndarray, query_ids: np.ndarray, targets: np.ndarray,
    thresholds: np.ndarray, k: int, strictness: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of the k nearest that each query finds in those of its probed lists that lie here.

    Lists are scanned one by one; what a query has found bounds what it looks for in the next.
    """
    by_list = np.argsort(lists, kind="stable")
    columns = np.ascontiguousarray(index.place(own[by_list]).T)
    placed = index.place_query(targets)
    probed = np.zeros((len(targets), len(index.centres)), bool)
    np.put_along_axis(probed, index.nearest_lists(placed, index.probes), True, axis=1)
    names, starts = np.unique(lists[by_list], return_index=True)
    thresholds = thresholds.copy()
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
    for name, start, end in zip(names, starts, [*starts[1:], len(lists)], strict=True):
        asking = np.flatnonzero(probed[:, name])
        step = max(1, PAIRS // (end - start))
        new = [held]
        for a in range(0, len(asking), step):
            some = asking[a : a + step]
            of, which, far = adaptive_scan(columns[:, start:end], placed[some], thresholds[some], strictness)
            which = by_list[which + start]
            other = ids[which] != query_ids[some[of]]
            of, which, far = of[other], which[other], far[other]
            near = _nearest_of_each(of, far, len(some), k)
            of, which, far = some[of[near]], which[near], far[near]
            new.append([of, which, exact_scores(own[which], targets[of]), far])
        of, which, scores, far = (np.concatenate(x) for x in zip(*new, strict=True))
        order = np.lexsort((ids[which], -scores, of))
        rank = np.arange(len(of)) - np.searchsorted(of[order], of[order])
        held = [x[order[rank < k]] for x in (of, which, scores, far)]
        last = order[rank == k - 1]
        thresholds[of[last]] = np.minimum(thresholds[of[last]], far[last])
    return held[0], held[1], held[2]


def exact_scores(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed in the order of the components."""
    total = 0.0
    for j in range(vectors.shape[-1]):
        total = total + vectors[..., j] * points[..., j]
    return total


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    lists: int | None = None,
    probes: int | None = None,
    recall: float = 0.99,
    strictness: float = 2.1,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k vectors found with the largest inner product.

    ``queries`` has the columns of ``vectors``; a vector with the query's id is no candidate of it. Ties go to the
    smaller id. Scores are exact on the original vectors. Rows with a null id or an unusable vector (null, empty, zero,
    null or non-finite parts), and vectors of another size than most of the sample's, take no part. Fewer than k
    candidates give fewer rows, empty tables none. A repeated row is a candidate each time; of repeated queries the one
    with the greatest vector is asked. Other columns are ignored.

    The index is fitted on a bounded sample (SAMPLE rows with the least hashes) but holds every row. ``probes`` lists are
    scanned for a query; if not given, as many as find the share ``recall`` of neighbours within the sample. A query
    travels once to a bundle of lists and brings k rows back. Bundles, and blocks of queries, are bounded in bytes; a list
    that is larger is split over bundles, so a vector that very many rows share does no harm.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    rows = usable(vectors, vec_id, vector)
    asked = usable(queries, vec_id, vector).groupBy("vec_id").agg(F.max("vector").alias("vector"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["vector"]
    if sample.empty:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = int(sample.map(len).mode().iloc[0])
    sized = F.size("vector") == dim
    stats = rows.where(sized).agg(
        F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)).alias("square")
    ).first()
    lists = lists or max(1, min(MOST_LISTS, -(-stats.n // LIST_ROWS), math.isqrt(stats.n)))
    kept = np.array(sample[sample.map(len) == dim].tolist())
    index = Index(kept, math.sqrt(stats.square) * (1 + 1e-12), lists, probes, k, recall, seed)
    shipped = spark.sparkContext.broadcast(index)

    def floats(column) -> np.ndarray:
        return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)

    def assign(batches):
        for batch in batches:
            own = shipped.value.nearest_lists(shipped.value.place(floats(batch.column("vector"))), 1)[:, 0]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(own, pa.int32())], names=["vec_id", "vector", "list"])

    path = scratch_path(spark, "neighbour-lists")
    assigned = rows.where(sized).mapInArrow(assign, "vec_id long, vector array<double>, list int")
    assigned.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    held = spark.read.parquet(path)
    some = held.select("row", "vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(max(KNOWN, 4 * k)).toPandas()
    known = spark.sparkContext.broadcast(
        Known(index, some["row"].to_numpy(), some["vec_id"].to_numpy(), np.array(some["vector"].tolist()).reshape(-1, dim))
    )

    sizes = {r["list"]: r["count"] for r in held.groupBy("list").count().collect()}  # one row for each list
    most = max(1, BUNDLE_BYTES // (8 * dim))
    bundles = bundles_of(sizes, max(1, min(most, -(-stats.n // BUNDLES))))
    query_blocks = max(1, -(-usable(queries, vec_id, vector).count() // most))

    def probe(batches):
        for batch in batches:
            index, seen = shipped.value, known.value
            points, ids = floats(batch.column("vector")), batch.column(0).to_numpy()
            placed = index.place_query(points)
            asks = [
                sorted({at for n in near if n in bundles for at in range(bundles[n][0], sum(bundles[n]))})
                for near in index.nearest_lists(placed, index.probes).tolist()
            ]
            threshold, of, at, scores = seen.near(points, placed, ids, k)
            seeds = pa.StructArray.from_arrays(
                [pa.array(seen.rows[at]), pa.array(seen.ids[at]), pa.array(scores)], ["row", "vec_id", "score"]
            )
            starts = pa.array(np.searchsorted(of, np.arange(len(ids) + 1)), pa.int32())
            columns = [batch.column(0), batch.column(1), pa.array(asks, pa.list_(pa.int32()))]
            columns += [pa.array(threshold, pa.float64()), pa.ListArray.from_arrays(starts, seeds)]
            yield pa.record_batch(columns, names=["query_id", "vector", "bundles", "threshold", "seeds"])

    def lookup(part: int):
        return F.create_map(*[F.lit(x) for n, place in bundles.items() for x in (n, place[part])])[F.col("list")]

    parts = held.withColumn("bundle", (lookup(0) + F.pmod(F.xxhash64("row"), lookup(1))).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    )
    schema = "query_id long, vector array<double>, bundles array<int>, threshold double, "
    probed = asked.where(sized).mapInArrow(probe, schema + "seeds array<struct<row:long,vec_id:long,score:double>>")
    wanted = probed.select(
        "query_id",
        "vector",
        "threshold",
        F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("block"),
        F.explode("bundles").alias("bundle"),
    )
    seeds = probed.select("query_id", F.inline("seeds"))

    def scan(rows: pa.Table, points: pa.Table) -> pa.Table:
        names = ["query_id", "row", "vec_id", "score"]
        if not rows.num_rows or not points.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())], names=names)
        own, targets = (floats(t.column("vector").combine_chunks()) for t in (rows, points))
        ids, query_ids = rows.column("vec_id").to_numpy(), points.column("query_id").to_numpy()
        of, which, scores = scan_lists(
            shipped.value, rows.column("list").to_numpy(), ids, own, query_ids, targets,
            points.column("threshold").to_numpy(), k, strictness,
        )
        return pa.table([pa.array(x) for x in (query_ids[of], rows.column("row").to_numpy()[which], ids[which], scores)], names=names)

    found = (
        parts.groupBy("bundle", "block")
        .cogroup(wanted.groupBy("bundle", "block"))
        .applyInArrow(scan, "query_id long, row long, vec_id long, score double")
    )
    once = found.unionByName(seeds).dropDuplicates(["query_id", "row"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


@query()
def op1_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"))
