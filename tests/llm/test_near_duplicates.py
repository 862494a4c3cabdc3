"""Near duplicates against brute force."""

import random
from collections import Counter

import numpy as np

from corpusloom.llm.near_duplicates import bag_min_hash, components, near_duplicates, op7_near_duplicates

SF = "/root/testdata/sf0.001"


def bag(text, n=5):
    words = (text or "").split()
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or Counter([tuple(words)] if words else [])


def brute(rows, threshold=0.8):
    """Class of each row: its smallest (id, place)."""
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            a, b = bags[i], bags[j]
            if not a and not b or a and b and sum((a & b).values()) >= threshold * sum((a | b).values()):
                parent[root(i)] = root(j)
    classes = {}
    for k in range(len(rows)):
        classes.setdefault(root(k), []).append(k)
    return classes.values()


def check(got, rows):
    expected = sorted(sorted(str(rows[k][0]) for k in c) for c in brute(rows))
    found = {}
    for r in got:
        found.setdefault(str(r.class_id) if r.doc_id is not None or r.class_id is not None else r.row, []).append(str(r.doc_id))
    assert sorted(map(sorted, found.values())) == expected
    kept = Counter(str(r.class_id) for r in got if r.kept)
    assert sum(kept.values()) == len(expected)
    assert all(r.doc_id == r.class_id for r in got if r.kept)


def near_copies(rng, words, base, n, edits):
    for _ in range(n):
        copy = base[:]
        for _ in range(edits):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        yield " ".join(copy)


def test_registered(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(op7_near_duplicates(spark, SF).collect(), rows)


def test_odd_texts(spark):
    rng = random.Random(1)
    words = [f"w{n}" for n in range(3000)]
    texts = ["", None, "  ", "one two", "one two", "one  two ", "a b c d e", "a b c d e f", "la " * 500, "la " * 550, "la " * 700]
    base = [rng.choice(words) for _ in range(200)]
    texts += [" ".join(base), *near_copies(rng, words, base, 40, 3)]  # some pairs above the threshold, some below
    chain = [rng.choice(words) for _ in range(300)]
    texts += [" ".join(chain[k * 12 : k * 12 + 150]) for k in range(12)]  # each is near the next only
    texts += [" ".join(rng.choice(words) for _ in range(60)) for _ in range(30)]
    texts += [" ".join(base)] * 30
    rows = [(n, t) for n, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "x", 2) for r in rows], "doc_id long, text string, label string, row int").repartition(3)
    check(near_duplicates(docs).collect(), rows)
    assert near_duplicates(docs.where("doc_id = 9999")).collect() == []
    odd = spark.createDataFrame([(None, "p q r s t u"), (None, "p q r s t u"), (7, "x y"), (7, "x y"), (8, "x y")], "doc_id long, text string")
    got = near_duplicates(odd).collect()
    assert sorted(str((r.doc_id, r.class_id)) for r in got) == ["(7, 7)", "(7, 7)", "(8, 7)", "(None, None)", "(None, None)"]
    assert sum(r.kept for r in got) == 2


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    a, b = rng.integers(1, 12, 60), rng.integers(1, 12, 60)
    text = np.repeat([0, 1], 60)
    found = bag_min_hash(text, np.concatenate([hashes, hashes]), np.concatenate([a, b]), 2, 4000)
    exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert np.isfinite(found).all()
    assert abs((found[0] == found[1]).mean() - exact) < 0.03


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    assert {r.node: r.label for r in components(edges).collect()} == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def test_components_of_chains_stars_and_loops(spark, monkeypatch):
    """Labels are least nodes; edges of one round are not read by the next."""
    from corpusloom.llm import near_duplicates as module

    n = 400
    star = [(n, k) for k in range(2 * n, 3 * n)] + [(k, n) for k in range(2 * n, 2 * n + 9)]
    chain = [(k, k + 1) for k in range(4 * n, 5 * n)]
    far = [(9 * n + k, 6 * n + k) for k in range(9)] + [(9 * n + k, 6 * n + k + 1) for k in range(9)]
    edges = [*star, *chain, *far, (7, 7)]
    sizes = []

    def write(df, name, inner=module._write):
        out = inner(df, name)
        sizes.extend([out.count()] if name == "edges" else [])
        return out

    monkeypatch.setattr(module, "_write", write)
    got = {r["node"]: r["label"] for r in module.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = {k: n for k in [n, *range(2 * n, 3 * n)]} | {k: 4 * n for k in range(4 * n, 5 * n + 1)} | {7: 7}
    expected |= {k: 6 * n for pair in far for k in pair}
    assert got == expected
    assert sizes[0] == len({tuple(sorted(e)) for e in edges}) and sum(sizes[1:]) < sizes[0] / 10
