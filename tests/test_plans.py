"""Texts stay where they are: no exchange of the explained plans carries them while the lists of keys are short."""

import re

import pytest

from __spark_entry__ import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("name", "texts"),
    [
        ("refresh_index", {"content", "code"}),
        ("skip_reasons", {"content"}),
        ("pack_context", {"text"}),
        ("qa_context", {"code"}),
        ("embed_documents", {"text"}),
    ],
)
def test_no_exchange_carries_texts(spark, name, texts):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = queries()[name](spark, SF_DIR)
        plan = frame._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    moved = re.findall(r"\) Exchange[^\n]*\nInput \[\d+\]: \[([^\]]*)\]", plan)
    columns = {c.split("#")[0].strip() for row in moved for c in row.split(",")}
    # the rows a question has found travel to their question; their number is bounded by it
    allowed = {"pack_context": {"text"}, "qa_context": {"code"}}.get(name, set())
    assert not columns & (texts - allowed)
    if allowed:
        assert "BroadcastHashJoin" in plan


def test_first_build_moves_no_text(spark, monkeypatch):
    """All files are new, so the list of files to do is as long as it can be."""
    from corpusloom.functions import rows
    from corpusloom.plans.derived import repo_files
    from corpusloom.plans.refresh import refresh_index
    from corpusloom.schemas import INDEX

    monkeypatch.setattr(rows, "FEW_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = refresh_index(repo_files(spark, SF_DIR), spark.createDataFrame([], INDEX), "m")
        plan = frame._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )
        assert frame.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = re.findall(r"\) Exchange[^\n]*\nInput \[\d+\]: \[([^\]]*)\]", plan)
    # the old rows of the index, which has none, meet their keys; the files' texts stay
    assert not {c.split("#")[0].strip() for row in moved for c in row.split(",")} & {"content"}
