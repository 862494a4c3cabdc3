"""Neighbours against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm.neighbours import KNOWN, LIST_ROWS, SAMPLE, Index, adaptive_scan, exact_scores, nearest, op1_neighbours


def brute(rows, k, every=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if i % every == 0:
            others = ids != i
            s = exact_scores(x[others], np.array(v, float))
            top = np.lexsort((ids[others], -s))[:k]
            out[i] = list(zip(ids[others][top].tolist(), s[top].tolist()))
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_registered_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    exact, got = brute(rows, 20), found(op1_neighbours(spark, f"/root/testdata/{sf}").collect())
    assert got.keys() == exact.keys()
    hits = sum(len({i for i, _ in exact[q]} & {i for i, _ in got[q]}) for q in exact)
    assert hits >= 0.95 * sum(map(len, exact.values()))
    x = dict(rows)
    for q, near in got.items():
        assert len(near) == 20 and near == sorted(near, key=lambda n: (-n[1], n[0])) and q not in dict(near)
        assert all(s == exact_scores(np.array([x[i]], float), np.array(x[q], float))[0] for i, s in near)


def test_odd_vectors(spark):
    rng = np.random.default_rng(0)
    good = [(n, [float(v) for v in rng.standard_normal(6) * (1 + n % 5)]) for n in range(300)]
    good += [(n, good[7][1]) for n in range(300, 900)]  # one vector on two thirds of the rows
    nan, inf = float("nan"), float("inf")
    bad = [
        (1000, None), (1020, []), (1040, [0.0] * 6), (1060, [1.0, None, 1, 1, 1, 1]), (1080, [nan, 1.0, 1, 1, 1, 1]),
        (1100, [inf, 1.0, 1, 1, 1, 1]), (1120, [1.0, 2.0]), (None, [1.0] * 6),
    ]
    table = spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], 5, "x") for i, v in good + bad],
                                  "vec_id long, embedding array<float>, rank int, list string")
    good = [tuple(r) for r in table.where("vec_id < 1000").select("vec_id", "embedding").collect()]
    queries = table.where("vec_id % 20 = 0")
    got = found(nearest(table, queries, k=5, lists=8, probes=8, strictness=50.0).collect())
    assert got == brute(good, 5)
    few = table.where("vec_id < 3")
    assert {q: len(n) for q, n in found(nearest(few, few).collect()).items()} == {0: 2, 1: 2, 2: 2}
    nothing = table.where("vec_id >= 1000")
    assert nearest(nothing.where("vec_id < 1080"), queries).collect() == []
    assert nearest(table, nothing.where("vec_id = 1000")).collect() == []


def test_scan_abandons_most_and_keeps_the_nearest():
    rng = np.random.default_rng(2)
    columns, points = rng.standard_normal((64, 4000)), rng.standard_normal((5, 64))
    far = ((columns.T[None] - points[:, None]) ** 2).sum(axis=2)
    of, which, left = adaptive_scan(columns, points, np.sort(far, axis=1)[:, 40], 2.1)
    for q in range(5):
        near = set(np.argsort(far[q])[:20].tolist())
        assert len(near & set(which[of == q].tolist())) >= 19
    assert len(of) <= 5 * 41 and np.allclose(left, far[of, which])
    assert len(adaptive_scan(columns, points, np.full(5, np.inf), 2.1)[0]) == 5 * 4000


def mixed(n, sigma, seed=1, dim=64):
    """Random directions with lognormal lengths."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True) * np.exp(sigma * rng.standard_normal((n, 1)))


@pytest.mark.parametrize("sigma", [0.0, 0.3, 0.5])
def test_probed_lists_hold_the_neighbours_whatever_the_lengths(sigma):
    x = mixed(40_000, sigma)
    index = Index(x[:SAMPLE], np.linalg.norm(x, axis=1).max() * (1 + 1e-12), 20, None, 20, 0.99, 7)
    own = index.nearest_lists(index.place(x), 1)[:, 0]
    scores = x[:300] @ x.T
    scores[np.arange(300), np.arange(300)] = -np.inf
    near = np.argpartition(-scores, 20, axis=1)[:, :20]
    probed = index.nearest_lists(index.place_query(x[:300]), index.probes)
    assert (own[near][:, :, None] == probed[:, None]).any(axis=2).mean() >= 0.97


@pytest.mark.parametrize("sigma", [0.0, 0.5])
def test_recall_far_above_the_known_rows(spark, sigma):
    """Many lists, default probes and strictness; also of the neighbours that only the scan can find."""
    x = mixed(60_000, sigma).astype(np.float32)
    flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
    columns = {"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": flat}
    rows = spark.createDataFrame(pa.table(columns)).repartition(8)
    got = found(nearest(rows, rows.where("vec_id % 200 = 0")).collect())
    known = {r[0] for r in rows.select("vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(KNOWN).collect()}
    assert len(got) == 300 and len(x) > 7 * KNOWN and len(x) > 20 * LIST_ROWS
    x, wanted, scanned = x.astype(float), [], []
    for q, near in got.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        mine = {i for i, _ in near}
        for i in np.argpartition(-scores, 20)[:20].tolist():
            wanted.append(i in mine)
            if i not in known:
                scanned.append(i in mine)
    assert np.mean(wanted) >= 0.95 and np.mean(scanned) >= 0.95
