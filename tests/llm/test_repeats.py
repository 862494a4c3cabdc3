"""Repeated passages against brute force."""

import hashlib
import re

import pytest

from corpusloom.llm.substrings import drop_repeated_passages, op9_substrings

SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"p{k}" for k in range(60))
ODD = [
    (5, f"one two {PASSAGE} three", 7), (2, f"{PASSAGE}", 7), (9, f"four\n{PASSAGE}\t{PASSAGE}", 7), (None, None, 7),
    (None, f"start {PASSAGE[:120]} end", 7), (1, "", 7), (3, "  \n ", 7), (7, "la " * 300, 7), (8, "la " * 25, 7),
    (6, "é ü " * 40, 7), (6, "é ü " * 40, 7), (4, "short text", 7), (4, "short text", 7), (11, " x" + "y" * 3000, 7),
]


def brute_passages(rows, window):
    """rows: (id, text) in order of age."""
    seen, out = set(), []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("window", [2, 5, 20])
def test_passages(spark, window):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, row long").repartition(3)
    got = drop_repeated_passages(docs, window, carry=[]).collect()
    ages = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    order = [(r[0], r[1]) for r in ages]
    # rows with a null id differ in content, and equal ids hold equal texts, so their order is the table's
    nulls = [r for r in sorted(got, key=lambda r: r.row) if r.doc_id is None]
    order[:2] = [(None, r.text or None) for r in nulls]
    rows = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in got]
    assert by_id(rows) == by_id(brute_passages(order, window))
    for r in got:
        assert sum(s.length for s in r.spans) == r.n_removed
    assert drop_repeated_passages(docs.where("doc_id = 99"), window).collect() == []


def test_registered_passages(spark):
    rows = sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    got = [tuple(r) for r in op9_substrings(spark, SF).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert by_id(got) == by_id(brute_passages(rows, 20))
    assert sum(r[2] for r in got) > 0


def test_words_alike_to_a_polynomial_hash(spark):
    """Two words that polynomials modulo a power of two can't tell apart: no window repeats, nothing is alike."""
    from corpusloom.llm.fingerprints import fingerprint_documents
    from corpusloom.llm.near_duplicates import near_duplicates

    for size in (1024, 2048, 4096):
        word = "".join("ab"[bin(k).count("1") % 2] for k in range(size))
        rest = " ".join(f"w{k}" for k in range(19))
        docs = spark.createDataFrame(
            [(1, f"{word} {rest}"), (2, f"{word.translate(str.maketrans('ab', 'ba'))} {rest}"), (3, word), (4, word[::-1] + "a")],
            "doc_id long, text string",
        )
        assert [r.n_removed for r in drop_repeated_passages(docs).collect()] == [0] * 4
        sketch = {r.doc_id: bytes(r.sketch) for r in fingerprint_documents(docs).collect()}
        assert len(set(sketch.values())) == 4
        assert all(r.kept for r in near_duplicates(docs.where("doc_id < 3"), shingle=20).collect())
