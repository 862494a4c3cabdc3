"""Byte-pair counts and chunks against the library, one text at a time."""

import base64
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import byte_tokens as bt

P = pytest.importorskip("public_tokenizers")
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pairs(spark):
    return bt.BytePairs(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_all_documents(spark, pairs, library):
    """Every document: counts, ids, offsets that cover the text's bytes, and the way back."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {k: None if t is None else library.encode_ordinary(t) for k, t in texts.items()}
    counts = {r["doc_id"]: r["n_tokens"] for r in bt.byte_pair_counts(docs, pairs).collect()}
    assert counts == {k: None if v is None else len(v) for k, v in want.items()}
    for n in (7, 256):
        rows = bt.byte_pair_chunks(docs, pairs, n).withColumn("piece", pairs.decode(F.col("token_ids")))
        chunks = {}
        for r in sorted(rows.collect(), key=lambda r: (r["doc_id"], r["chunk"])):
            chunks.setdefault(r["doc_id"], []).append(r)
        assert set(chunks) == {k for k, v in want.items() if v}
        for k, own in chunks.items():
            whole = texts[k].encode()
            assert [r["chunk"] for r in own] == list(range(len(own)))
            assert all(r["n_tokens"] == n for r in own[:-1]) and 0 < own[-1]["n_tokens"] <= n
            assert [i for r in own for i in r["token_ids"]] == want[k]
            assert [r["begin"] for r in own] == [0, *[r["end"] for r in own[:-1]]] and own[-1]["end"] == len(whole)
            assert all(bytes(r["piece"]) == whole[r["begin"] : r["end"]] for r in own)


def test_odd_texts(spark, pairs, library):
    texts = [None, "", " ", "<|endoftext|>", "naïve 日本語 👩‍👩‍👧 \r\n\t", "a" * 200_000, "it's 'S 12345 ___ !!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    got = {r["id"]: r["ids"] for r in docs.select("id", pairs.encode(F.col("text")).alias("ids")).collect()}
    assert got == {i: None if t is None else library.encode_ordinary(t) for i, t in enumerate(texts)}
    blank = spark.createDataFrame([(" " * 1_200_000 + "x",), ("\n" * 1_200_000,)], "text string")
    rows = blank.select("text", pairs.encode(F.col("text")).alias("ids")).select(
        F.decode(pairs.decode(F.col("ids")), "UTF-8") == F.col("text")
    )
    assert [r[0] for r in rows.collect()] == [True, True]
    assert bt.byte_pair_chunks(docs.limit(0), pairs).collect() == []
    assert bt.byte_pair_chunks(docs.where("id < 2"), pairs).collect() == []
    with pytest.raises(ValueError):
        bt.byte_pair_chunks(docs, pairs, 0)


def test_only_texts_reach_python(spark, pairs):
    """Columns that are carried stay in the engine, and unused ones are not read."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    plan = bt.byte_pair_counts(docs, pairs).select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "ArrowEvalPython" in plan
