"""Exact duplicates against brute force."""

import hashlib
from collections import defaultdict

import pyarrow as pa
import pytest

from corpusloom.llm import copies
from corpusloom.llm.copies import exact_copies

LONG = "Lorem ÉÀ ipsum " * 100_000
ODD = [
    (5, "Same Text", 1), (3, "same text", 2), (9, "SAME TEXT", 3), (None, "same text", 4), (7, None, 5), (1, "", 6),
    (2, "É", 7), (4, "é", 8), (6, LONG, 9), (8, LONG.lower().replace("ÉÀ".lower(), "ÉÀ"), 10), (11, LONG + "x", 11),
    (None, "alone", 12), (None, "alone", 13), (12, "twice", 14), (12, "twice", 15), (-1, "x" * 64 + "a", 16),
    (-2, "x" * 64 + "b", 17), (-(1 << 63), "X" * 64 + "a", 18), (10, "same text ", 19), (13, "a\0b", 20), (14, "A\0B", 21),
]
SCHEMA = "doc_id long, text string, edge int"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, choose):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lower(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best, left = (choose(known) if known else None), 1
        for i in ids:
            kept = i == best and left > 0
            left -= kept
            out.append((i, best, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def result(frame):
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_odd(spark, keep):
    docs = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    assert result(exact_copies(docs, keep)) == brute([r[:2] for r in ODD], min if keep == "smallest" else max)
    assert exact_copies(docs.where("doc_id = 99"), keep).collect() == []


def test_names_and_keep(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumnsRenamed({"doc_id": "id", "text": "content"})
    docs = docs.selectExpr("id", "content", "1 as kept", "2 as part", "3 as run", "4 as lead")
    assert len(exact_copies(docs, doc_id="id", text="content").collect()) == len(ODD)
    with pytest.raises(ValueError):
        exact_copies(docs, "any")


def test_a_text_over_many_ranges(spark):
    """Half of all rows have one text; splitters cut through it, and one row of it stays."""
    docs = spark.range(60_000).selectExpr(
        "id as doc_id", "case when id % 2 = 0 then 'Common' when id % 3 = 0 then concat('t', id % 50) else concat('u', id) end as text"
    ).repartition(40)
    got = exact_copies(docs, "largest")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(got) == brute(rows, max)


def test_pieces_and_groups(monkeypatch):
    """A text that a splitter cuts through leaves its run with its bytes; equal keys of different texts are told apart."""
    monkeypatch.setattr(copies, "MOST_IDS", 2)
    batch = pa.record_batch([pa.array([4, None, 9, 1, 2]), pa.array(["A", "a", "A", "b", "a"])], names=["doc_id", "text"])
    (got,) = copies._pieces(True)([batch])
    assert list(zip(got.column("content").to_pylist(), got.column("ids").to_pylist())) == [
        (b"a", [9, 4]), (b"a", [2, None]), (b"b", [1])
    ]
    lead = b"x" * 64
    rows = pa.record_batch(
        [pa.array([lead + b"1", lead + b"2", lead + b"2", lead + b"3", b"y", b"z"]), pa.array([7, 7, 7, 8, 9, 10]),
         pa.array([[1], [2], [3], [4], [5], [6]])], names=["content", "mark", "ids"],
    )
    found = [(g.content[-1:], sum(map(len, g.ids)), edge) for g, edge in copies._groups([rows.slice(0, 2), rows.slice(2)])]
    assert found == [(b"1", 1, True), (b"2", 2, True), (b"3", 1, False), (b"y", 1, False), (b"z", 1, True)]
