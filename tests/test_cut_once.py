"""Files are dealt to all cores and cut once, and walks read written edges."""

import pytest

from corpusloom.functions import rows as row_functions
from corpusloom.operators import code_graph, graph
from corpusloom.plans.catalog import QUERIES
from corpusloom.plans.derived import code_files, graph_edges


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """A table ``part`` of one file with one group of rows."""
    folder = tmp_path_factory.mktemp("parts")
    rows = [(k, f"name {k}", "Brand#1", "ECONOMY", k % 7, 1.0) for k in range(1, 41)]
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_files_are_dealt_to_all_cores(spark, parts):
    files = code_files(spark, parts)
    dealt = files.rdd.glom().map(len).collect()
    assert sum(n > 0 for n in dealt) >= spark.sparkContext.defaultParallelism
    assert sorted(r.file_id for r in files.collect()) == list(range(1, 41))


def test_many_rows_ask_for_more_tasks_than_the_known_cores(spark):
    """Executors may come after the query is made, so cores alone don't say how many tasks there must be."""
    tasks = 3 * spark.sparkContext.defaultParallelism
    rows = spark.range(0, (tasks - 1) * row_functions.ROWS_PER_TASK + 1, 1, 1)
    dealt = row_functions.spread(rows).rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert len(dealt) == tasks and 0 < max(dealt) <= row_functions.ROWS_PER_TASK + 1


@pytest.mark.parametrize(("name", "times"), [("function_parameters", 1), ("call_graph", 0), ("class_graph", 0)])
def test_files_are_cut_once(spark, parts, name, times):
    """What is left to do when a query is returned; what was written before is read from there."""
    assert _plan(QUERIES[name](spark, parts)).count("FileScan parquet") == times


def test_calls_down_to_files_cut_files_once(spark, parts):
    plan = _plan(QUERIES["resolved_calls"](spark, parts))
    # one scan lists the paths that imports may name
    assert plan.count("FileScan parquet") == 1 and "array_distinct" not in plan


@pytest.mark.parametrize("name", ["resolved_calls", "resolved_imports"])
def test_joins_down_to_files_do_not_pass_the_driver(spark, parts, name):
    frame = QUERIES[name](spark, parts)
    assert frame.collect()
    plan = _plan(frame)  # the one that ran
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_blocks_are_stored_before_they_are_searched(spark, parts):
    assert "posexplode" not in _plan(QUERIES["view_function_code"](spark, parts))


def test_parameters_of_both_sides(spark, parts):
    rows = QUERIES["function_parameters"](spark, parts).where("filepath like '%/m_5.py'").collect()
    assert sorted((r.name, r.side) for r in rows) == [("a", "input"), ("b=5", "input"), ("int", "output"), ("self", "input")]


def test_calls_of_a_repeated_and_a_nameless_function(spark):
    schema = "filepath string, language string, code_type string, function_name string, code string"
    f, g = "def f(x):\n    return g(x) + h(x)", "def g(x):\n    return x"
    rows = [("a.py", "python", "function", "f", f)] * 2 + [("a.py", "python", "function", "g", g), ("a.py", "python", "function", None, f)]
    assert [tuple(r) for r in code_graph.call_graph(spark.createDataFrame(rows, schema)).collect()] == [("f", "g")]


def test_walks_read_written_edges(spark, parts, monkeypatch):
    plans = []

    def kept(df, inner=graph.cut_lineage):
        plans.append(_plan(df))
        return inner(df)

    monkeypatch.setattr(graph, "cut_lineage", kept)
    edges = graph_edges(spark, parts)
    rows = graph.hierarchy_from_roots(spark.createDataFrame([("f_1",)], "name string"), edges)
    assert rows.count() >= edges.count()
    # the first plan makes the edges; the first hop looks for the roots too
    assert len(plans) > 4
    assert not any("FileScan" in plan or "Broadcast" in plan for plan in plans[1:])
