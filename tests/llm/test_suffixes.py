"""Repeated byte strings against brute force, and the merge against sorting."""

import hashlib

import numpy as np
import pytest

from corpusloom.llm.suffixes import CodedRun, drop_repeated_bytes, front_coded, merge_runs, op3_suffixes, shared_prefix

SF = "/root/testdata/sf0.001"
PASSAGE = "".join(chr(97 + k * k % 23) for k in range(90)) + "äöü"
ODD = [
    (1, f"one {PASSAGE} two", "k"), (2, PASSAGE, "k"), (3, f"x{PASSAGE}{PASSAGE}y", "k"), (None, None, "k"),
    (None, f"nn{PASSAGE[3:70]}", "k"), (4, "", "k"), (5, "z" * 500, "k"), (6, "0123456789" * 60, "k"),
    (7, "copy of a text, " * 3, "k"), (7, "copy of a text, " * 3, "k"), (8, "é" * 100, "k"), (9, "\x00" * 90, "k"),
    (10, "short", "k"), (11, PASSAGE[:40] + "!" + PASSAGE[41:], "k"), (12, "q\x00" + PASSAGE[20:60] + "\x00", "k"),
    (13, "q\x00" + PASSAGE[20:60], "k"),
]


def brute(rows, length):
    seen = {}
    for n, (_, text) in enumerate(rows):
        raw = (text or "").encode()
        for s in range(len(raw) - length + 1):
            seen.setdefault(hash(raw[s : s + length]), []).append((n, s))
    gone = [np.zeros(len((t or "").encode()), bool) for _, t in rows]
    for places in seen.values():
        if len(places) > 1:
            for n, s in places:
                gone[n][s : s + length] = True
    out = []
    for (i, text), g in zip(rows, gone):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        spans = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        out.append((i, len(raw), int(g.sum()), spans, hashlib.sha256(raw[~g].tobytes()).hexdigest()))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize(("length", "seed"), [(16, 4), (30, 30), (50, 16), (64, 1)])
def test_bytes(spark, length, seed):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, kept string").repartition(3)
    got = drop_repeated_bytes(docs, length, seed).collect()
    rows = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got]
    assert by_id(rows) == by_id(brute([r[:2] for r in ODD], length))
    assert all(sum(s.length for s in r.spans) == r.n_removed for r in got)
    assert drop_repeated_bytes(docs.where("doc_id = 99"), length, seed).collect() == []


def test_registered_bytes(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = [tuple(r) for r in op3_suffixes(spark, SF).select(*columns).collect()]
    assert by_id(got) == by_id(brute(rows, 200))
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("runs", [1, 2, 3, 7])
def test_merge(runs):
    rng = np.random.default_rng(runs)
    lists = [sorted(bytes(rng.choice(list(b"ab"), 12)) for _ in range(int(rng.integers(1, 60)))) for _ in range(runs)]
    coded = [CodedRun(front_coded(x, np.zeros((len(x), 2), "<u2"), np.zeros(len(x), bool))) for x in lists]
    merged = list(merge_runs(coded))
    assert [s for _, s, _ in merged] == sorted(x for one in lists for x in one)
    for (_, a, _), (_, b, common) in zip(merged, merged[1:]):
        assert common == shared_prefix(a, b, 0)
