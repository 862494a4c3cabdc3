"""Toxicity: held-out accuracy, the label model on votes with a known truth, odd texts."""

import zlib

import numpy as np
import pytest

from corpusloom.llm.toxicity import fit, label_model, op4_toxicity, score


# The smaller table has a handful of labelled toxic texts in each language but English, too few to learn their words from.
@pytest.mark.parametrize(("sf", "least"), [("sf0.01", 0.7), ("sf0.1", 0.9)])
def test_held_out_accuracy(spark, sf, least):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").collect()}
    rows = op4_toxicity(spark, f"/root/testdata/{sf}").collect()
    assert len(rows) == spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").count()
    right = {True: 0, False: 0}
    total = {True: 0, False: 0}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.held_out and r.doc_id in labels:
            toxic = labels[r.doc_id] == 1
            total[toxic] += 1
            right[toxic] += (r.predicted == 1) == toxic
    print(right, total)
    assert right[True] >= least * total[True]
    assert right[False] >= 0.97 * total[False]


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.2
    good, weak = np.where(truth, rng.random(4000) < 0.8, rng.random(4000) < 0.02), rng.random(4000) < 0.2
    votes = np.column_stack([good, good, good, np.where(truth, rng.random(4000) < 0.7, rng.random(4000) < 0.03), weak]).astype(float)
    given = np.where(rng.random(4000) < 0.05, ~truth, truth).astype(float)
    chance, accuracy, weights = label_model(votes, given)
    assert ((chance > 0.5) == truth).mean() > 0.96
    assert accuracy[0] > 0.85 and accuracy[3] > 0.8 and accuracy[4] < 0.4
    assert weights[:3].max() < 0.5 < weights[3]  # three copies of one voter count about once


def test_odd_texts(spark):
    docs = [(n, f"fine words number {n} about rain and wheat", 0.5) for n in range(60)]
    docs += [(n, f"zorgly words number {n} about rain and wheat", 0.5) for n in range(60, 100)]
    odd = [(None, None, 0.5), (200, "", 0.5), (201, None, 0.5), (202, "ZORGLY " * 50_000, 0.5), (203, "x" * 100_000, 0.5), (203, "x", 0.5)]
    table = spark.createDataFrame(docs + odd, "doc_id long, text string, score double")
    labels = spark.createDataFrame(
        [(n, int(n >= 60)) for n in range(0, 100, 2)] + [(None, 1), (1, None), (4, 0), (4, 0)], "doc_id long, label int"
    )
    got = score(table, fit(table, labels)).collect()
    assert len(got) == len(docs) + len(odd)
    assert all((r.score > 0.5) == (60 <= r.doc_id < 100 or r.doc_id == 202) for r in got if r.doc_id is not None)
    assert {round(r.score, 9) for r in got if r.doc_id in (200, 201, None)} == {round(next(r.score for r in got if r.doc_id == 200), 9)}
    empty = table.where("doc_id = 999")
    assert score(empty, fit(table, labels)).collect() == []
    untrained = score(table, fit(table, labels.where("doc_id = 999"))).collect()
    assert all(r.score < 0.3 for r in untrained)
    assert fit(empty, labels).features == []
