"""Fingerprints against exact shingle sets and brute-force pairing."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F

from corpusloom.llm.fingerprints import (
    compare_with_edited, containment, distinct, fingerprint_documents, merge_sketches, merged, op8_fingerprints,
    resemblance, sketches,
)

SF = "/root/testdata/sf0.001"


def shingles(text, n=5):
    words = text.split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edits(rows):
    """(doc_id, text, edited, next text) in descending order of ids."""
    rows = sorted(rows, key=lambda r: -r[0])
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        yield i, t, t[: len(t) - len(t) // 2] + after[: len(t) // 2], after


def check(got, rows, k=128):
    got = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for i, t, edited, after in edits(rows):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for estimate, other in ((r.near_edited, edited), (r.near_next, after)):
            exact = alike(t, other)
            small = len(shingles(t) | shingles(other)) <= k
            assert abs(estimate - exact) <= (1e-9 if small else 5 * (exact * (1 - exact) / k) ** 0.5 + 0.02)


def test_registered(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op8_fingerprints(spark, SF).collect()
    check(got, rows)
    by_text = {}
    for r in got:
        by_text.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_odd_texts(spark):
    rng = random.Random(2)
    words = [f"w{n}" for n in range(400)]
    long = " ".join(rng.choices(words, k=30_000))
    rows = [(1, "é" * 7), (2, ""), (3, long), (4, long), (5, "a b c"), (6, "one two three four five six"), (9, "  ")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, place string, bucket int")
    got = compare_with_edited(docs.repartition(3)).withColumn("edited_sha256", F.sha2("edited", 256)).collect()
    check(got, rows)
    one = compare_with_edited(docs.where("doc_id = 6")).collect()
    assert [(r.doc_id, r.near_next, r.edited) for r in one] == [(6, 1.0, rows[5][1][:14] + rows[5][1][:13])]
    assert compare_with_edited(docs.where("doc_id = 99")).collect() == []
    odd = spark.createDataFrame([(None, None), (None, "x y"), (7, "t"), (7, "t")], "doc_id long, text string")
    assert len(compare_with_edited(odd).collect()) == 4
    assert sum(r.n_shingles for r in fingerprint_documents(odd).collect()) == 3


def test_estimates_and_merging(spark):
    rng = np.random.default_rng(1)
    words = [f"w{n}" for n in range(5000)]
    a = " ".join(rng.choice(words, 3000))
    b = a + " " + " ".join(rng.choice(words, 3000))
    x, y = sketches(pa.array([a, b]), 256, 5)
    assert abs(distinct(x, 256) / len(shingles(a)) - 1) < 0.3
    assert abs(resemblance(x, y, 256) - alike(a, b)) < 0.15
    assert containment(x, y, 256) > 0.85
    assert abs(containment(y, x, 256) - 0.5) < 0.15
    parts = sketches(pa.array(a.split(" ") and [" ".join(a.split()[i : i + 104]) for i in range(0, 3000, 100)]), 256, 5)
    assert (merged(parts, 256) == x).all()
    docs = spark.createDataFrame([(n, " ".join(a.split()[n * 100 : n * 100 + 104])) for n in range(30)], "doc_id long, text string")
    rows = fingerprint_documents(docs, 256).withColumn("key", F.lit("all")).repartition(4)
    (whole,) = merge_sketches(rows, "key", 256).collect()
    assert np.array_equal(np.frombuffer(whole.sketch, "<u8"), x)
