"""Near duplicates by BagMinHash: weighted-Jaccard signatures of word-shingle multisets, bands, and verification.

A shingle of weight w owns a Poisson process on each of the intervals (0, 1], (1, 2], (2, 4], ... that begin below w. The
points of an interval's process fall on its unit levels evenly, by a hierarchy of halves in effect; one counts if its
level is at most w, so two texts share exactly the points below both weights. Every point has a slot of the signature,
which keeps the least. A process is followed only until it passes the greatest value of its text's signature.

Texts that agree in a band are compared by the exact overlap of their multisets. Not all pairs of a bucket are: each
member is compared with a hub, and pairs that links have already joined need no comparison. What remains are strays,
members outside the largest class of a bucket; each goes once to every run that holds members of its buckets and is
compared there. In the end every pair of texts that shares a bucket is in one class or was compared.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.registry import query, table, texts
from corpusloom.llm.runs import MOST_BUCKETS, Runs
from corpusloom.llm.words import mix, parts_of, run_starts, runs_of_words, words_of
from corpusloom.session import scratch_path

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Rounds of comparisons with one hub for each bucket, before the strays are compared in full.
HUB_ROUNDS = 3


def bags(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, weight) of the multiset of each text's runs of ``shingle`` words, sorted.

    A text with fewer words has one shingle, all its words; one without words has none.
    """
    words = words_of(column)
    counts = np.diff(words.first)
    hashes = runs_of_words(words.hash, shingle)[run_starts(words.first, shingle)]
    of = np.repeat(np.arange(len(counts)), np.maximum(counts - shingle + 1, 0))
    few = np.flatnonzero((counts > 0) & (counts < shingle))
    short = np.zeros(len(few), np.uint64)
    for j in range(shingle - 1):
        has = counts[few] > j
        short[has] = mix(short[has] * np.uint64(31) + words.hash[words.first[few[has]] + j])
    hashes, of = np.concatenate([hashes, short]), np.concatenate([of, few])
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return of[at], hashes[at], np.diff(np.append(at, len(hashes)))


def units(of: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int) -> list[np.ndarray]:
    """Each text's multiset as a sorted set: every copy of a shingle has a hash of its own."""
    copy = np.arange(int(weights.sum())) - np.repeat(np.cumsum(weights) - weights, weights)
    each = mix(np.repeat(hashes, weights) + copy.astype(np.uint64) * _STEP)
    text = np.repeat(of, weights)
    order = np.lexsort((each, text))
    each, edges = each[order], np.searchsorted(text, np.arange(n + 1))
    return [each[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _uniform(seed: np.ndarray, k: int) -> np.ndarray:
    return ((mix(seed + np.uint64(k * int(_STEP) % (1 << 64))) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def bag_min_hash(of: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, slots: int) -> np.ndarray:
    """Signatures (n x slots) of multisets; two of them agree in a slot with the probability of their weighted Jaccard
    similarity. That of an empty multiset is infinite throughout."""
    parts, begin, size = [], 0, 1
    while len(of) and begin < weights.max():
        at = np.flatnonzero(weights > begin)
        parts.append((of[at], mix(hashes[at] ^ np.uint64(begin)), weights[at], np.full(len(at), begin), np.full(len(at), size)))
        begin, size = begin + size, size if begin == 0 else size * 2
    signature = np.full(n * slots, np.inf)
    if not parts:
        return signature.reshape(n, slots)
    text, seed, weight, begin, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    at, k = np.zeros(len(text)), 0
    while len(text):
        for _ in range(int(np.clip(200_000 // len(text), 1, 64))):
            at = at - np.log(_uniform(seed, 2 * k)) / size
            place = _uniform(seed, 2 * k + 1) * slots
            slot = place.astype(np.int64)
            level = begin + 1 + ((place - slot) * size).astype(np.int64)
            counts = level <= weight
            np.minimum.at(signature, text[counts] * slots + slot[counts], at[counts])
            k += 1
        on = at < signature.reshape(n, slots).max(axis=1)[text]
        text, seed, weight, begin, size, at = (x[on] for x in (text, seed, weight, begin, size, at))
    return signature.reshape(n, slots)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n x bands) hashes of each band's number and values."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1).astype(np.uint64) * _STEP), bits.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * np.uint64(31) + mix(bits[:, :, r]))
    return key.view(np.int64)


def _write(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the least node of its component.

    A round gives each node the least of itself and its neighbours and follows these to their ends, by halves. Edges go on
    between the ends; those within one are done with, so later rounds read what few edges are left.
    """
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    live = _write(edges.select(*ends).distinct(), "edges")
    labels = None
    while True:
        both = live.union(live.select("b", "a"))
        led = _write(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("end")), "ends")
        while True:
            jump = led.select(F.col("node").alias("end"), F.col("end").alias("next"))
            new = _write(led.join(jump, "end").select("node", F.col("next").alias("end"), F.col("end").alias("old")), "ends")
            led = new.select("node", "end")
            if new.where("end <> old").isEmpty():
                break
        if labels is None:
            labels = led.withColumnRenamed("end", "label")
        else:
            further = led.select(F.col("node").alias("label"), "end")
            labels = _write(
                labels.join(further, "label", "left").select("node", F.coalesce("end", "label").alias("label")), "labels"
            )
        moved = live.join(led.select(F.col("node").alias("a"), F.col("end").alias("to_a")), "a").join(
            led.select(F.col("node").alias("b"), F.col("end").alias("to_b")), "b"
        )
        moved = moved.where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        live = _write(moved.select(*ends).distinct(), "edges")
        if live.isEmpty():
            return labels


class _Bags:
    """Multisets of the texts that share a bucket, by run."""

    def __init__(self, runs: Runs, wanted: DataFrame, shingle: int):
        spark = runs.texts.sparkSession

        def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
            names = ["run", "row", "bag"]
            here = np.isin(rows.column("row").to_numpy(), asked.column("row").to_numpy())
            rows = rows.filter(pa.array(here))
            found = []
            for _, part in parts_of(rows.column("text")) if rows.num_rows else ():
                found += [x.astype("<u8").tobytes() for x in units(*bags(part, shingle), len(part))]
            return pa.table([rows.column("run"), rows.column("row"), pa.array(found, pa.binary())], names=names)

        bags_ = runs.texts.groupBy("run").cogroup(wanted.groupBy("run")).applyInArrow(run, "run long, row long, bag binary")
        name = f"bags_{uuid.uuid4().hex}"
        (
            bags_.write.format("parquet")
            .option("path", scratch_path(spark, "bags"))
            .bucketBy(min(runs.shares, MOST_BUCKETS), "run")
            .sortBy("run")
            .saveAsTable(name)
        )
        self.rows = spark.table(name)

    def compare(self, pairs: DataFrame, threshold: float) -> DataFrame:
        """Of pairs (row, run, hub, hub_run) those (a, b) that are alike. A hub's multiset goes once to each run."""
        asked = pairs.select(F.col("hub").alias("row"), F.col("hub_run").alias("run"), F.col("run").alias("target")).distinct()

        def send(rows: pa.Table, asked: pa.Table) -> pa.Table:
            order = {r: n for n, r in enumerate(rows.column("row").to_pylist())}
            at = [order[r] for r in asked.column("row").to_pylist()]
            sent = rows.column("bag").take(pa.array(at, pa.int64()))
            return pa.table([asked.column("target"), asked.column("row"), sent], names=["run", "hub", "bag"])

        sent = self.rows.groupBy("run").cogroup(asked.groupBy("run")).applyInArrow(send, "run long, hub long, bag binary")
        given = sent.select("run", "hub", "bag", F.lit(None).cast("long").alias("row")).union(
            pairs.select("run", "hub", F.lit(None).cast("binary"), "row")
        )

        def judge(rows: pa.Table, given: pa.Table) -> pa.Table:
            own = dict(zip(rows.column("row").to_pylist(), rows.column("bag").to_pylist(), strict=True))
            hubs, members = {}, {}
            for hub, bag, row in zip(*(given.column(c).to_pylist() for c in ("hub", "bag", "row")), strict=True):
                if row is None:
                    hubs[hub] = np.frombuffer(bag, "<u8")
                else:
                    members.setdefault(hub, []).append(row)
            alike: list[tuple[int, int]] = []
            for hub, rows_ in members.items():
                near = _alike(hubs[hub], [own[r] for r in rows_], threshold)
                alike += [(r, hub) for r, ok in zip(rows_, near.tolist(), strict=True) if ok]
            return pa.table([pa.array([p[k] for p in alike], pa.int64()) for k in (0, 1)], names=["a", "b"])

        return self.rows.groupBy("run").cogroup(given.groupBy("run")).applyInArrow(judge, "a long, b long")

    def compare_strays(self, own: DataFrame, threshold: float) -> DataFrame:
        """Links (a, b) between classes, of buckets (key, row, run, label) that hold several.

        No pairs are listed: a stray travels with its buckets to each run, which knows its own members of them. Of a
        stray's links to one class of a run, one is returned for each part of the run's members.
        """
        sizes = own.groupBy("key", "label").agg(F.count("*").alias("size"))
        largest = sizes.groupBy("key").agg(F.max(F.struct("size", "label")).alias("most"))
        runs_of = own.groupBy("key").agg(F.collect_set("run").alias("targets"))
        strays = (
            own.join(largest, "key")
            .where(F.col("label") != F.col("most.label"))
            .join(runs_of, "key")
            .groupBy("row", "run", "label")
            .agg(F.array_distinct(F.flatten(F.collect_list("targets"))).alias("targets"), F.collect_set("key").alias("keys"))
        )
        asked = strays.select("row", "run", "label", "keys", F.explode("targets").alias("target"))

        def send(rows: pa.Table, asked: pa.Table) -> pa.Table:
            order = {r: n for n, r in enumerate(rows.column("row").to_pylist())}
            at = [order[r] for r in asked.column("row").to_pylist()]
            return pa.table(
                [
                    *(asked.column(c) for c in ("target", "row", "label")),
                    asked.column("keys").cast(pa.list_(pa.int64())),
                    rows.column("bag").take(pa.array(at, pa.int64())),
                ],
                names=["run", "row", "label", "keys", "bag"],
            )

        sent = self.rows.groupBy("run").cogroup(asked.groupBy("run")).applyInArrow(
            send, "run long, row long, label long, keys array<long>, bag binary"
        )
        here = own.select("run", "row", "label", F.array("key").alias("keys"), F.lit(None).cast("binary").alias("bag"))

        def judge(rows: pa.Table, given: pa.Table) -> pa.Table:
            bag_of = dict(zip(rows.column("row").to_pylist(), rows.column("bag").to_pylist(), strict=True))
            members: dict[int, list] = {}
            strays = []
            columns = (given.column(c).to_pylist() for c in ("row", "label", "keys", "bag"))
            for row, label, keys, bag in zip(*columns, strict=True):
                if bag is None:
                    members.setdefault(keys[0], []).append((row, label))
                else:
                    strays.append((row, label, keys, bag))
            links = []
            for stray, label, keys, bag in strays:
                others = sorted({m for key in keys for m in members.get(key, ()) if m[1] != label})
                for at in range(0, len(others), 512):
                    part = others[at : at + 512]
                    near = _alike(np.frombuffer(bag, "<u8"), [bag_of[r] for r, _ in part], threshold)
                    links += {other: (stray, r) for (r, other), ok in zip(part, near.tolist(), strict=True) if ok}.values()
            return pa.table([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        given = sent.unionByName(here)
        return self.rows.groupBy("run").cogroup(given.groupBy("run")).applyInArrow(judge, "a long, b long")


def _alike(hub: np.ndarray, bags_: list[bytes], threshold: float) -> np.ndarray:
    """Whether each of some multisets, as sorted unit hashes, has the similarity with the hub's."""
    units_ = np.frombuffer(b"".join(bags_), "<u8")
    sizes = np.array([len(b) // 8 for b in bags_])
    place = np.minimum(np.searchsorted(hub, units_), len(hub) - 1)
    hits = np.concatenate([[0], np.cumsum(hub[place] == units_)])
    ends = np.cumsum(sizes)
    common = hits[ends] - hits[ends - sizes]
    return common >= threshold * (sizes + len(hub) - common) - 1e-9


def near_duplicates(
    docs: DataFrame,
    threshold: float = 0.8,
    shingle: int = 5,
    bands: int = 25,
    rows: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per input row: doc_id, class_id, kept, n_shingles, text; with ``carry`` also ``rest``, a struct of those
    columns.

    Two texts are linked if the weighted Jaccard similarity of the multisets of their shingles is at least ``threshold``;
    a class is a connected component. ``class_id`` is the least doc_id of the class, and ``kept`` marks its row, of
    several the first in the table; so exactly one row of a class is kept. Null ids count as greater than all others.
    ``bands`` of ``rows`` slots find a pair of similarity s with the chance 1 - (1 - s**rows)**bands, 0.99995 at 0.8.

    A text of fewer words than a shingle is one shingle; texts without words (null or empty ones too) are copies of each
    other. Repeated rows are copies. An empty table gives no rows. Other columns are ignored.

    Texts of equal multisets are one node. Nothing lists the pairs of a bucket: members meet one hub at a time, and after
    some rounds only strays, outside the bucket's largest class, are compared with the others. Multisets of hubs and
    strays travel once to each run.
    """
    runs = Runs(texts(docs, doc_id, text, carry), "near_duplicates")

    def sign(found: pa.Table, _) -> pa.Table:
        digests, sizes, keys = [], [], []
        for _, part in parts_of(found.column("text")):
            of, hashes, weights = bags(part, shingle)
            edges = np.searchsorted(of, np.arange(len(part) + 1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                digests.append(hashlib.blake2b(hashes[a:b].tobytes() + weights[a:b].tobytes(), digest_size=16).digest())
            totals = np.concatenate([[0], np.cumsum(weights)])
            sizes.append(totals[edges[1:]] - totals[edges[:-1]])
            keys.append(band_keys(bag_min_hash(of, hashes, weights, len(part), bands * rows), bands, rows))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(keys).ravel(), pa.int64()), bands)
        return pa.table(
            [*(found.column(c) for c in ("run", "row", "doc_id")), pa.array(digests, pa.binary()),
             pa.array(np.concatenate(sizes), pa.int64()), lists.cast(pa.list_(pa.int64()))],
            names=["run", "row", "doc_id", "digest", "n_shingles", "keys"],
        )

    signed = _write(
        runs.each(sign, "run long, row long, doc_id long, digest binary, n_shingles long, keys array<long>"), "signatures"
    )
    order = (F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    nodes = _write(
        signed.groupBy("digest")
        .agg(F.min(F.struct(*order, "run", "n_shingles", "keys")).alias("first"))
        .select("digest", "first.*"),
        "nodes",
    )
    exploded = nodes.where("n_shingles > 0").select("row", "run", F.explode("keys").alias("key"))
    shared = exploded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    members = _write(exploded.join(shared, "key"), "bucket-members")
    compared = _Bags(runs, members.select("row", "run").distinct(), shingle)

    labels = None
    for turn in range(HUB_ROUNDS + 1):
        own = members.withColumn("label", F.col("row"))
        if labels is not None:
            own = members.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn(
                "label", F.coalesce("label", "row")
            )
            mixed = own.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key")
            own = _write(own.join(mixed, "key"), "mixed-buckets")
        if own.isEmpty():
            break
        if turn < HUB_ROUNDS:
            pairs = _write(_pairs_with_hubs(own, turn).select("row", "run", "hub", "hub_run").distinct(), "pairs")
            found = _write(compared.compare(pairs, threshold), "links")
        else:
            found = _write(compared.compare_strays(own, threshold), "links")
        # an edge to its label stands for all earlier links of a node
        labels = components(found if labels is None else found.union(labels.select("node", "label")))

    labelled = nodes.select("digest", "no_id", "doc_id", "row")
    if labels is not None:
        labelled = labelled.join(labels.withColumnRenamed("node", "row"), "row", "left")
        labelled = labelled.withColumn("label", F.coalesce("label", "row"))
    else:
        labelled = labelled.withColumn("label", F.col("row"))
    labelled = _write(labelled, "node-labels")
    classes = labelled.groupBy("label").agg(F.min(F.struct("no_id", "doc_id", "row")).alias("first"))
    by_digest = labelled.join(classes, "label").select(
        "digest", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("kept_row")
    )
    decided = _write(
        signed.join(by_digest, "digest").select(
            "run", "row", "class_id", (F.col("row") == F.col("kept_row")).alias("kept"), "n_shingles"
        ),
        "decisions",
    )
    columns = ["doc_id", "class_id", "kept", "n_shingles", "text", "row"] + ["rest"] * (carry is not None)
    return runs.stored.join(decided, ["run", "row"]).select(*columns)


def _pairs_with_hubs(own: DataFrame, turn: int) -> DataFrame:
    """Every member with its bucket's hub of this turn, unless they are in one class."""
    hub = F.min(F.struct(F.xxhash64("row", F.lit(turn)).alias("order"), "row", "run", "label")).alias("hub")
    hubs = own.groupBy("key").agg(hub)
    return (
        own.join(hubs, "key")
        .where("label <> hub.label")
        .select("row", "run", F.col("hub.row").alias("hub"), F.col("hub.run").alias("hub_run"))
    )


@query()
def op7_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept", "n_shingles")
