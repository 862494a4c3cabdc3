"""Counts of filters in every order against brute force."""

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from corpusloom.llm.filter_audit import audit_filters, audited_filters, mask_cells

GOOD = " ".join(f"word{k}" for k in range(60))
DOCS = [
    (1, GOOD, "a", 1), (2, GOOD, "b", 1), (3, GOOD, "a", 1), (3, GOOD, "a", 1), (None, GOOD, None, 1), (None, "only null", "", 1),
    (None, "only null", "", 1), (4, None, "a", 1), (5, "", "a", 1), (6, "la " * 70, "b", 1), (7, GOOD.upper(), "b", 1),
    (8, GOOD + " $", "b", 1), (9, "\t x\x0by\x0cz \n", "b", 1), (10, "é" * 19 + "A", "b", 1), (11, "é" * 18 + "A", "c", 1),
    (12, "A&B " * 40_000, "c", 1), (1, "twice", "c", 1), (2, "twice", "a", 1), (1, "twice", "a", 1),
]
LABELS = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (4, None, 1), (6, 1, None), (6, 0, 1), (None, 1, 1), (99, 1, 1), (7, 1, 0)]


def brute(docs, labels, names="ABCDE"):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, *_ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    rows = []
    for d, text, part, *_ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": t in least and (d is None or d > least[t]),
        }
        rows.append((part or "", "".join(n for n in names if fails[n]), d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in map("".join, permutations(names)):
            for k, f in enumerate(order):
                gone = [r for r in mine if f in r[1] and not set(r[1]) & set(order[:k])]
                out[part, order, k + 1] = [
                    sum(not set(r[1]) & set(order[: k + 1]) for r in mine), len(gone),
                    sum(f in r[1] and bool(set(r[1]) & set(order[:k])) for r in mine), sum(r[1] == f for r in mine),
                    sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
        for f in names:
            total = sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == f)
            for (p, o, s), v in out.items():
                if p == part and o[s - 1] == f:
                    v.append(total)
    return {k: tuple(v) for k, v in out.items()}


def result(frame):
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in columns) for r in frame.collect()}


def test_odd(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string, mask int").repartition(4)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = result(audit_filters(docs, labels, audited_filters()))
    assert got == brute(DOCS, LABELS)
    assert len(got) == 600 * 4
    assert audit_filters(docs.where("doc_id = 77"), labels, audited_filters()).collect() == []
    none = result(audit_filters(docs, labels.where("quality = 9"), audited_filters()))
    assert none == brute(DOCS, [])


def test_other_filters(spark):
    """Fewer filters, one of which is never known, and other names of columns."""
    docs = spark.createDataFrame([(1, "x"), (2, "xy"), (3, "x")], "id long, content string").withColumn("first", F.lit("p"))
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    filters = {"n": F.lit(None).cast("boolean"), "l": F.length("text") > 1, "c": None}
    got = audit_filters(docs, labels, filters, "id", "content", "first")
    assert got.count() == 18
    assert {(r.step, r.removed, r.good_lost, r.shapley) for r in got.where("substr(filter_order, step, 1) = 'c'").collect()} == {
        (k, 1, 1, 6) for k in (1, 2, 3)
    }
    with pytest.raises(ValueError):
        audit_filters(docs, labels, {c: F.lit(True) for c in "abcdefg"})
    with pytest.raises(ValueError):
        audit_filters(docs, labels, {"ab": F.lit(True)})


def test_no_text_is_shuffled(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string, mask int")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    plan = mask_cells(docs, labels, audited_filters())._jdf.queryExecution().executedPlan().toString()
    for line in re.findall(r"Exchange [^\n]*", plan):
        assert "text#" not in line
