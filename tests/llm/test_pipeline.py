"""The stages of the pipeline against brute force, each on its own input."""

import pyspark.sql.functions as F
import pytest

from corpus_pipeline import STAGES, run
from corpusloom.llm.toxicity import fit, learning_labels, score
from tests.llm.test_near_duplicates import brute as classes
from tests.llm.test_repeats import brute_passages
from tests.llm.test_tokens import check_packing, library  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {"documents": docs}
    for name, stage in STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = found[name] = spark.read.parquet(path)
    return found


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "text", "lang", "source", "n_chars").collect()))


def test_toxicity(spark, steps):
    docs = steps["documents"]
    model = fit(docs, learning_labels(spark.read.parquet(f"{SF}/labels.parquet")))
    scores = {r.doc_id: r.score for r in score(docs, model).collect()}
    assert rows(steps["toxicity"]) == [r for r in rows(docs) if scores[r[0]] < 0.3]
    assert len(rows(docs)) * 0.8 < len(rows(steps["toxicity"])) < len(rows(docs))


def test_near_duplicates(steps):
    given = rows(steps["toxicity"])
    assert rows(steps["near_duplicates"]) == sorted(given[min(c)] for c in classes([r[:2] for r in given]))


def test_substrings(steps):
    given, got = rows(steps["near_duplicates"]), rows(steps["substrings"])
    expected = brute_passages([r[:2] for r in given], 20)
    import hashlib

    assert len(got) == len(given)
    for before, after, (_, _, removed, sha) in zip(given, got, expected):
        if removed:
            assert hashlib.sha256(after[1].encode()).hexdigest() == sha and after[4] == len(after[1])
            assert (before[0], before[2:4]) == (after[0], after[2:4])
        else:
            assert before == after


def test_packing(steps, library):  # noqa: F811
    check_packing(steps["packing"].collect(), [r[:2] for r in rows(steps["substrings"])], library)


def test_odd_documents(spark):
    odd = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id here", None, "s", 10), (None, None, "en", "s", None),
        (3, "short", "en", None, 5), (3, "short", "en", None, 5), (4, "word " * 40_000, "en", "s", 200_000),
    ]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = "no_text rest row run kept spans class_id n_words digest ids own_lang".split()
    wide = docs.withColumns({c: F.lit(k) for k, c in enumerate(clashing)})
    for name, stage in STAGES[:3]:
        got = stage(spark, wide, SF)
        assert got.columns == wide.columns and got.select(*docs.columns).count() == stage(spark, docs, SF).count()
        assert [tuple(r) for r in got.select(*clashing).distinct().collect()] == [tuple(range(len(clashing)))]
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.where("doc_id = 99"), SF).collect() == []
    pieces = STAGES[3][1](spark, wide, SF).collect()
    assert sorted({str(r.doc_id) for r in pieces}) == ["1", "2", "3", "4", "None"]
    assert sum(r.length for r in pieces) == sum(r.length for r in STAGES[3][1](spark, docs, SF).collect())
    assert sum(r.doc_tokens for r in pieces if r.doc_id in (1, 2)) == 2 and all(r.length > 0 for r in pieces)
    assert STAGES[3][1](spark, docs.where("doc_id = 99"), SF).collect() == []
    kept = STAGES[1][1](spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "4", "None"]
    assert [r.text for r in kept if r.doc_id == 1] == [None]
    whole = STAGES[2][1](spark, docs, SF).collect()
    assert [(r.text, r.n_chars) for r in whole if r.doc_id == 4] == [("word", 4)]
    assert len(whole) == len(odd)


def test_run(spark, steps):
    columns = steps["packing"].columns
    assert run(spark, SF).select(F.sum("length")).first() == steps["packing"].select(F.sum("length")).first()
    assert columns == run(spark, SF).columns
