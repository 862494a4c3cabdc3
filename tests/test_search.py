"""Tokens, vectors, fuzzy names, context packing against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import python_tuple
from corpusloom.operators import near_names
from corpusloom.operators import search as ops
from corpusloom.operators import tokens as tok
from corpusloom.operators import vectors as vec


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.fixture(scope="module")
def index(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(600):
        v = rng.normal(size=8)
        # a third of the rows are copies of one vector
        v = np.ones(8) if i % 3 == 0 else v
        rows.append((f"b{i:04d}", [float(x) for x in v / np.linalg.norm(v)]))
    rows.append(("none", None))
    return spark.createDataFrame(rows, "block_id string, code_embedding array<float>").repartition(5).cache()


@pytest.mark.parametrize("block, rows", [(1000, 1000), (4, 1000), (1000, 50), (4, 50)])
def test_batch_search_equals_single_search(spark, index, block, rows):
    queries = index.filter("code_embedding is not null").orderBy("block_id").limit(9).select(
        F.col("block_id").alias("query_id"), F.col("code_embedding").alias("query_embedding")
    )
    batch = vec.semantic_search_batch(index, queries, k=4, query_block=block, index_block=rows).collect()
    for q in queries.collect():
        single = vec.semantic_search(index, q["query_embedding"], k=4).collect()
        mine = sorted((r for r in batch if r["query_id"] == q["query_id"]), key=lambda r: r["rank"])
        assert [r["block_id"] for r in mine] == [r["block_id"] for r in single]
        assert np.allclose([r["similarities"] for r in mine], [r["similarities"] for r in single])


def test_batch_search_of_few(spark, index):
    """Fewer rows than k, and none on either side; nothing passes the driver."""
    queries = index.where("block_id in ('b0001', 'none')").selectExpr("block_id as query_id", "code_embedding as query_embedding")
    two = index.where("block_id in ('b0002', 'b0005')")
    assert vec.semantic_search_batch(two, queries, k=4).count() == 2
    assert vec.semantic_search_batch(index.where("block_id = 'x'"), queries).collect() == []
    assert vec.semantic_search_batch(index, queries.where("query_id = 'x'")).collect() == []
    spark.sparkContext.setJobGroup("planned", "only planned")
    vec.semantic_search_batch(index, queries)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planned")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_fuzzy_batch_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    names = ["".join(rng.choice(list("abc"), size=rng.integers(0, 9))) for _ in range(150)] + ["hot"] * 80
    rows = [(i, None if i % 2 else n[:2], n[2:] if not i % 2 else n or None) for i, n in enumerate(names)]
    table = spark.createDataFrame(rows, "block_id int, class_name string, function_name string")
    full = [(i, (c or "") + (f or "")) for i, c, f in rows]
    asked = ["hot", "", "abcabcabcabcabc", "zz", "ab", "aabbcc"]
    got = ops.find_function_match_batch(table, spark.createDataFrame([(a,) for a in asked], "asked string"), k=5)
    by = {}
    for r in got.collect():
        by.setdefault(r["asked"], []).append((r["rank"], r["distance"], r["block_id"]))
    for a in asked:
        want = sorted((distance(n, a), i) for i, n in full)[:5]
        assert [(d, i) for _, d, i in sorted(by[a])] == want
        single = ops.find_function_match(table, a, k=5).collect()
        assert [(r["distance"], r["block_id"]) for r in single] == want


def test_fuzzy_batch_of_one_length(spark):
    """Nine tenths of the names have one length: the index compares few of them, and blocks give the same answers."""
    rng = np.random.default_rng(5)
    names = ["".join(rng.choice(list("abcdefghijklmnopqrst"), size=12)) for _ in range(900)]
    names += ["".join(rng.choice(list("abcdefghijklmnopqrst"), size=int(n))) for n in rng.integers(0, 30, size=100)]
    names += [names[0][:5] + "x" + names[0][5:], names[0][1:], names[0][:-2], names[0]]
    table = spark.createDataFrame([(i, None, n) for i, n in enumerate(names)], "block_id int, class_name string, function_name string")
    asked = [names[0], names[1], names[2][:6] + names[2][7:], "é" + names[3], "abcdefghabcdefghabcdefgh", "q", "", "q" * 40, None]
    asked_rows = spark.createDataFrame([(a,) for a in asked], "_asked string")
    known = table.groupBy(F.col("function_name").alias("_name")).agg(
        F.min("block_id").alias("_first"), F.count("*").cast("int").alias("_n")
    )
    by_name = {}
    for i, n in enumerate(names):
        by_name.setdefault(n, i)
    for block in (20_000, 50):
        got = {}
        for r in near_names.nearest_names(known, asked_rows, 3, block).collect():
            got.setdefault(r["_asked"], []).append((r["distance"], by_name[r["_name"]]))
        assert set(got) == {a for a in asked if a is not None}
        for a in got:
            assert sorted(got[a])[:3] == sorted((distance(n, a), i) for n, i in by_name.items())[:3]

    index = near_names.NameIndex(known)
    for radius in (1, 2, 3):
        one = spark.createDataFrame([(a, radius) for a in asked[:4]], "_asked string, _limit int")
        met = index.candidates(index.probes_within(one, index.rarest(one))).select("_asked", "_name").distinct().collect()
        pairs = {(r["_asked"], r["_name"]) for r in met}
        within = {(a, n) for a in asked[:4] for n in by_name if distance(n, a) <= radius}
        assert within <= pairs
        # a pair in its place is rare: 20 letters, and about 3, 5 and 7 pairs at as many places each
        print("compared", radius, len(pairs), len(within), 4 * len(by_name))
        assert len(pairs) <= (0.05, 0.1, 0.2)[radius - 1] * 4 * len(by_name)


def test_view_function_code_without_rows(spark):
    empty = spark.createDataFrame([], "block_id int, class_name string, function_name string, code string")
    asked = spark.createDataFrame([("f",)], "asked string")
    assert [r["answer"] for r in ops.view_function_code(empty, asked).collect()] == ["Not found."]


def test_pack_context_stops_at_first_overflow(spark):
    rows = [("q", 1, "a", 0.1, 10), ("q", 2, "b", 0.2, 50), ("q", 3, "c", 0.3, 1), ("r", 4, "d", 0.1, 999)]
    ranked = spark.createDataFrame(rows, "query_id string, doc_id int, text string, distances double, n_tokens int")
    got = {r["query_id"]: (r["context"], r["n_rows"]) for r in ops.pack_context(ranked, max_len=40).collect()}
    assert got == {"q": ("a", 1)}
    got = {r["query_id"]: r["context"] for r in ops.pack_context(ranked, max_len=80).collect()}
    assert got == {"q": "a\n\n###\n\nb\n\n###\n\nc"}


def test_long_text_is_averaged_by_chunk_length(spark):
    def model(chunks):
        return np.array([[len(c), 1.0] for c in chunks])

    docs = spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, None), (4, "a b c d e")], "id int, code string")
    for once in (False, True):
        got = {r["id"]: r["v"] for r in vec.embed(docs, model=model, out="v", chunk_tokens=2, once_per_text=once).collect()}
        want = np.array([2 * 2 + 2 * 2 + 1, 2 + 2 + 1.0])
        assert np.allclose(got[1], want / np.linalg.norm(want), atol=1e-6) and got[1] == got[4]
        assert got[2] is None and got[3] is None


def test_token_costs(spark):
    messages = spark.createDataFrame(
        [(1, "user", "two words", None), (1, "function", "x", "tool")], "conv_id int, role string, text string, name string"
    )
    count = lambda model: tok.chat_tokens(messages, name="name", model=model).first()["n_tokens"]
    # 3 per message, quoted role and text, quoted name + 1, reply 3
    assert count("gpt-4") == (3 + 3 + 4) + (3 + 3 + 3 + 3 + 1) + 3
    assert count("gpt-3.5-turbo-0301") == count("gpt-4") + 2 - 2
    assert count("my-gpt-4o-copy") == count("gpt-4")
    with pytest.raises(Exception, match="no token rule for model"):
        count("other")


def test_chunks_cover_all_tokens(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b"), (3, ""), (4, "  ")], "id int, text string")
    got = sorted((r["id"], r["chunk"], r["n_tokens"]) for r in tok.token_chunks(docs, 2).collect())
    assert got == [(1, 0, 2), (1, 1, 2), (1, 2, 1), (2, 0, 2)]
    with pytest.raises(ValueError):
        tok.token_chunks(docs, 0)


def test_tuple_text(spark):
    cases = [["a"], ["a", "b"], ["it's"], ['say "it\'s"'], ["a\\b\n"], None]
    rows = spark.createDataFrame([(c,) for c in cases], "x array<string>")
    got = [r[0] for r in rows.select(python_tuple(F.col("x"))).collect()]
    assert got == [str(tuple(c)) if c is not None else "None" for c in cases]
