"""Walks, conversation memory, replies, pages."""

import random
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import epochs
from corpusloom.functions.epochs import Rule

from corpusloom.operators import code_graph
from corpusloom.operators import graph as g
from corpusloom.operators import transcripts as t
from corpusloom.operators import web as w
from corpusloom.operators.extract import extract_blocks
from corpusloom.session import scratch_path
from corpusloom.streaming.memory import stream_memory_epochs


COSTS = pa.schema([("key", pa.string()), ("turn", pa.int64()), ("cost", pa.int64())])
RANGE_ROWS = pa.schema(
    [("part", pa.int32()), *[(f.name, f.type) for f in list(COSTS)[:2]], ("total", pa.int64()), ("epoch", pa.int32()),
     ("compressed", pa.bool_()), ("cost", pa.int64()), ("steps", epochs.STEPS)]
)


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def names(spark, *values, column="name"):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


RING = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "a")]


def test_depth(spark):
    e, start = edges(spark, *RING), names(spark, "a", column="source")
    levels = [{r["node"] for r in g.children_by_depth(e, start, d).collect()} for d in range(5)]
    assert levels == [set(), {"b"}, {"b", "c"}, {"a", "b", "c", "d"}, {"a", "b", "c", "d"}]
    assert {r["node"] for r in g.parents_by_depth(e, start, 1).collect()} == {"c", "e"}
    with pytest.raises(Exception, match="not found in the graph"):
        g.children(e, names(spark, "zz"), names(spark, "a")).collect()


def test_depth_of_many_sources(spark):
    """More sources than a block holds, on a graph with a hub that is split, loops and repeated edges."""
    rng = random.Random(11)
    pairs = [(f"n{rng.randrange(250)}", f"n{rng.randrange(250)}") for _ in range(260)]
    pairs += [("hub", f"n{i}") for i in range(0, 250, 2)] + [(f"n{i}", "hub") for i in range(0, 250, 40)] + pairs[:9]
    pairs += [("n1", "n1"), ("n3", None), (None, "n4")]
    follow = {}
    for a, b in pairs:
        follow.setdefault(a, set()).add(b)
    sources = [f"n{i}" for i in range(250)] + ["hub", "unknown", "hub"]
    start = names(spark, *sources, column="source")
    for depth in (2, None):
        want = set()
        for source in set(sources):
            seen, front, hops = set(), {source}, 0
            while front and (depth is None or hops < depth):
                hops += 1
                front = {b for a in front if a is not None for b in follow.get(a, ())} - seen
                seen |= front
                want |= {(source, b, hops) for b in front}
        for span in (10_000, 7):
            got = [tuple(r) for r in g.within_depth(edges(spark, *pairs), start, depth, span).collect()]
            assert len(got) == len(set(got)) and set(got) == want
    assert g.within_depth(edges(spark, *pairs), start.limit(0), None).collect() == []


def test_hierarchy(spark):
    e = edges(spark, *RING)
    rows = g.node_hierarchy(e, names(spark, "a"), child_levels=9).collect()
    assert sorted((">".join(r["path"]), r["is_cycle"]) for r in rows) == [
        ("a>b", False),
        ("a>b>c", False),
        ("a>b>c>a", True),
        ("a>b>c>d", False),
    ]
    nodes = names(spark, "a", "b", "c", "d", "e")
    full = g.hierarchy_from_roots(nodes, e, 10)
    assert full.filter("is_cycle").count() == 1 and full.count() == 5
    assert g.hierarchy_from_roots(nodes, e).count() == 5
    assert g.hierarchy_from_roots(nodes, e, 2).agg(F.max("depth")).first()[0] == 2


def test_fuzzy_keeps_slots_apart(spark):
    nodes = spark.createDataFrame([("foo", "fo"), ("bar", None), ("fooo", "zzz")], "name string, file_name string")
    rows = [tuple(r) for r in g.fuzzy_nodes(nodes, "foo", ["file_name"]).collect()]
    assert rows == [("foo", 0, 0), ("foo", 1, 1), ("fooo", 0, 1)]
    once = g.fuzzy_nodes(nodes, "foo", ["file_name"], distinct_nodes=True).collect()
    assert [r["name"] for r in once] == ["foo", "fooo", "bar"]


@pytest.mark.parametrize("threshold, base, summary", [(100, 10, 20), (30, 40, 5), (60, 0, 59), (1000000, 0, 0)])
def test_epochs_by_both_paths(spark, threshold, base, summary):
    rng = random.Random(threshold)
    rows = [(c, i, rng.choice([0, None, 1, 5, 20, 40])) for c, n in ((1, 400), (2, 3), (3, 60)) for i in range(4000, 4000 + n)]
    costs = spark.createDataFrame(rows, "conv_id long, turn long, cost long")
    want = []
    for conv in (1, 2, 3):
        total, epoch = base, 0
        for c, turn, cost in rows:
            if c == conv:
                total += cost or 0
                want.append((c, turn, total, epoch, total >= threshold))
                if total >= threshold:
                    total, epoch = base + summary, epoch + 1
    for ranges in (None, 1, 23):
        got = t.memory_epochs(costs, threshold, base, summary, ranges=ranges)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("size", [1, 3, 50])
def test_epochs_compose_over_ranges(size):
    """Ranges cut anywhere, batches of any size: the same rows as one message after the other."""
    rng = random.Random(size)
    rows = [(c, i, rng.choice([0, 0, 1, 2, 5, 9, 30])) for c in (None, *"abcdefg") for i in range(rng.choice([1, 2, 90]))]
    for rule in (Rule(20, 0, 0), Rule(20, 3, 19), Rule(20, 25, 5), Rule(20, 0, 21), Rule(10**9, 0, 0)):
        want, state = [], {}
        for c, i, cost in rows:
            total, epoch = state.get(c, (rule.base, 0))
            full = total + cost >= rule.threshold
            want.append((c, i, total + cost, epoch, full))
            state[c] = (rule.after, epoch + 1) if full else (total + cost, epoch)
        batch = lambda part, names: pa.record_batch([pa.array(x) for x in zip(*part)], names=names)
        got, edges, fronts = [], [], []
        for part, at in enumerate(range(0, len(rows), 37)):
            some = rows[at : at + 37]
            batches = [batch(some[k : k + size], ["key", "turn", "cost"]) for k in range(0, len(some), size)]
            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(epochs.TaskContext, "get", lambda part=part: SimpleNamespace(partitionId=lambda: part))
                for r in pa.Table.from_batches(
                    [b.cast(RANGE_ROWS) for b in epochs.scan_ranges(rule)(iter([b.cast(COSTS) for b in batches]))]
                ).to_pylist():
                    if r["steps"]:
                        assert len(r["steps"]["reach"]) <= rule.threshold + 1
                        edges.append((r["part"], r["key"], r["steps"]))
                    elif r["cost"] is not None:
                        fronts.append((r["part"], r["key"], r["turn"], r["cost"]))
                    else:
                        got.append(tuple(r[c] for c in ("key", "turn", "total", "epoch", "compressed")))
        edges.sort(key=lambda e: (e[1] is not None, e[1] or "", e[0]))
        (entries,) = epochs.follow_ranges(rule)([batch(edges, ["part", "key", "steps"])])
        entry = {r["part"]: (r["in_total"], r["in_epoch"]) for r in entries.to_pylist()}
        known = [(*f, *entry[f[0]]) for f in fronts]
        names = ["part", "key", "turn", "cost", "in_total", "in_epoch"]
        for b in epochs.scan_fronts(rule)([batch(known[k : k + size], names) for k in range(0, len(known), size)]):
            got += [tuple(r.values()) for r in b.to_pylist()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_stream_epochs_over_batches(spark):
    path = scratch_path(spark, "messages")
    rows = [(c, i, 10 + i if i != 7 else None) for i in range(12) for c in (1, 2)]
    late, *rest = rows[4:] + rows[:2]  # turn 2 of the first conversation comes last, turn 0 after turn 3
    rest += rows[2:4]
    for part in (rest[:8], rest[8:], [late, rows[0]]):
        spark.createDataFrame(part, "conv_id long, turn long, cost long").coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema("conv_id long, turn long, cost long").option("maxFilesPerTrigger", 1).parquet(path)
    out = scratch_path(spark, "out")
    run = (
        stream_memory_epochs(source, 40, 5, 1)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, "state"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    batch = t.memory_epochs(spark.createDataFrame(rows, "conv_id long, turn long, cost long"), 40, 5, 1)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, batch.collect()))


def test_transcripts_are_whole(spark):
    rows = [(1, i, "user", f"m{i}") for i in range(4090, 4100)]
    messages = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    line = t.transcript_line(F.col("role"), F.col("text"), F.lit(None), F.lit(None), F.lit(None))
    (whole,) = t.format_transcript(messages, line).collect()
    assert whole["transcript"] == "\n".join(f"user: m{i}" for i in range(4090, 4100))
    priced = messages.withColumn("cost", F.lit(10))
    done = {r["epoch"]: r["transcript"] for r in t.epoch_transcripts(priced, line, 40, 0, 10).collect()}
    assert done == {
        0: "\n".join(f"user: m{i}" for i in range(4090, 4094)),
        1: "\n".join(f"user: m{i}" for i in range(4094, 4097)),
        2: "\n".join(f"user: m{i}" for i in range(4097, 4100)),
    }


def test_replies_are_whole(spark):
    pieces = spark.createDataFrame([(1, 999_999, "a"), (1, 1_000_000, "b"), (1, 5, "")], "response_id int, seq long, delta string")
    assert [tuple(r) for r in t.assemble_deltas(pieces).collect()] == [(1, "ab")]


def test_links_outside_comments_and_scripts(spark):
    html = """<!-- <a href="/no">x</a> --><a href="/yes">y</a><script>s = '<a href="/no">z</a>';</script>
    <STYLE>a { content: '<a href="/no">' }</STYLE ><a href=/also>w</a>"""
    rows = w.page_links(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()
    assert [r["link"] for r in rows] == ["/yes", "/also"]


def test_hierarchy_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(80)], "src string, dst string")
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(81)], "name string")
    assert g.hierarchy_from_roots(nodes, edges).count() == 80


def test_system_first_over_segments(spark):
    rows = [(1, 0, "system"), (1, 1, "user"), (1, 5000, "system"), (1, 9000, "assistant"), (2, 3, "user")]
    got = t.latest_system_first(spark.createDataFrame(rows, "conv_id int, turn int, role string"))
    assert sorted((r["conv_id"], r["position"], r["turn"]) for r in got.collect()) == [
        (1, 1, 5000),
        (1, 2, 1),
        (1, 3, 9000),
        (2, 1, 3),
    ]


def test_replies(spark):
    texts = [
        "answer: FALSE\nEXPLANATION:  why not  \nmore",
        "x ANSWER: a ANSWER: b ",
        "ANSWER: Unsure",
        "```python\nx = 1\n```\n```python\ny\n```",
        "```js\nz\n```",
        None,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    c = F.col("c")
    got = rows.select(
        "i",
        t.extract_answer(c).alias("a"),
        t.extract_verdict(c).alias("v"),
        t.extract_fenced_code(c, "python").alias("f"),
        t.needs_elaboration(F.lit("p\n- a\n- b\n* c"), 2).alias("n"),
    ).orderBy("i").collect()
    assert [r["a"] for r in got] == [None, "a ANSWER: b", "Unsure", None, None, None]
    assert tuple(got[0]["v"]) == ("FALSE", False, "why not") and tuple(got[2]["v"]) == ("Unsure", None, None)
    assert [r["f"] for r in got] == [None, None, None, "x = 1", None, None]
    assert not got[0]["n"]


def test_bulk_generate_retries_and_reports(spark):
    def model(texts):
        return [ValueError("no") if text == "bad" else text.upper() for text in texts]

    rows = spark.createDataFrame([(1, "ok"), (2, "bad")], "id int, p string")
    got = {r["id"]: tuple(r) for r in t.bulk_generate(rows, "p", model, "id", attempts=3, wait_min=0, wait_max=0).collect()}
    assert got == {1: (1, "OK", 1, None), 2: (2, None, 3, "ValueError: no")}


def chunks(text, limit, strict):
    import re

    parts, out, used, chunk = text.split(". "), [], 0, []
    for s in parts:
        n = len(re.findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]", s))
        if used + n > limit:
            if strict or chunk:
                out.append(". ".join(chunk) + ".")
            chunk, used = [], 0
        if n > limit:
            continue
        chunk.append(s)
        used += n + 1
    if chunk and not strict:
        out.append(". ".join(chunk) + ".")
    return out if strict else [c[:-1] if c.endswith("..") else c for c in out]


@pytest.mark.parametrize("strict", [True, False])
def test_sentence_chunks(spark, strict):
    rng = random.Random(5)
    texts = [". ".join(" ".join("w" * rng.randint(1, 14))for _ in range(rng.randint(1, 400))) for _ in range(20)] + ["", "One."]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = rows.select("i", w.sentence_chunks(F.col("t"), 12, strict).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == [chunks(x, 12, strict) for x in texts]


def test_links(spark):
    html = (
        '<a href="/a/">x</a><A class="k" HREF=\'https://h.org/b?x=1&amp;y=2\'>y</a><a href="#top">z</a><abbr href="no">'
        '<a href="mailto:a@b">m</a><a href="https://else.org/c">e</a><a href="d">d</a><a name="n">n</a><a href="/a">again</a>'
    )
    pages = spark.createDataFrame([("https://h.org/", html)], "url string, html string")
    links = w.page_links(pages)
    assert links.count() == 7
    got = {r["link"] for r in w.domain_links(links, F.lit("h.org")).collect()}
    assert got == {"https://h.org/a", "https://h.org/b?x=1&y=2", "https://h.org/d"}


def test_reachable(spark):
    links = edges(spark, ("p", "q"), ("q", "r"), ("r", "p"), ("x", "y"))
    got = {tuple(r) for r in w.reachable_pages(links, names(spark, "p", "z", column="source")).collect()}
    assert got == {("p", "p"), ("p", "q"), ("p", "r"), ("z", "z")}


def test_html_text_and_titles(spark):
    html = "<p>a &lt; b &#233;&#x1F600; &nope; &amp;lt;</p><!-- <b>c</b> --><SCRIPT>if (a < b) {}</SCRIPT ><style>p{}</style>d"
    row = spark.createDataFrame([(html,)], "h string").select(
        w.html_to_text(F.col("h")), w.title_from_name(F.lit("0123456789_my-page_x#update.txt")), w.clean_newlines(F.lit("a\n\n\\n  b"))
    ).first()
    assert row[0] == "a < b é😀 &nope; &lt;d"
    assert row[1] == "my page x" and row[2] == "a  b"


def test_imports_resolve_to_files(spark):
    texts = {
        "app/main.py": "import os, utils\nfrom . import tools\nfrom .core.run import go\nfrom ..lib import x\nimport pkg.deep.mod\n",
        "app/utils.py": "", "lib/utils.py": "", "app/__init__.py": "", "app/core/run.py": "from ..utils import a\nimport main\n",
        "lib/__init__.py": "import utils\nimport lib\n", "src/pkg/deep/mod.py": "import deep.mod\n", "old/src/pkg/deep/mod.py": "",
        "os.sql": "", "web/a.ts": "import x from './b';\nimport y from '../web/ui';\nimport 'react';\nimport z from './b.ts';\n",
        "web/b.ts": "export { q } from './none';\n", "web/ui/index.ts": "", "web/b.py": "",
        "php/a.php": "<?php\nuse Model\\User;\nuse User;\nrequire 'inc/b.php';\n", "php/Model/User.php": "", "php/inc/b.php": "",
        "empty.py": None,
    }
    files = spark.createDataFrame(list(texts.items()), "filepath string, content string")
    got = {(r.filepath, r.module, r.target) for r in code_graph.resolved_imports(files).collect()}
    assert got == {
        ("app/main.py", "utils", "app/utils.py"), ("app/main.py", ".", "app/__init__.py"),
        ("app/main.py", ".core.run", "app/core/run.py"), ("app/main.py", "..lib", "lib/__init__.py"),
        ("app/main.py", "pkg.deep.mod", "src/pkg/deep/mod.py"), ("app/core/run.py", "..utils", "app/utils.py"),
        ("app/core/run.py", "main", "app/main.py"), ("lib/__init__.py", "utils", "lib/utils.py"),
        ("web/a.ts", "./b", "web/b.ts"), ("web/a.ts", "./b.ts", "web/b.ts"), ("web/a.ts", "../web/ui", "web/ui/index.ts"),
        ("php/a.php", "Model.User", "php/Model/User.php"), ("php/a.php", "inc/b.php", "php/inc/b.php"),
    }
    none = code_graph.resolved_imports(files.limit(0))
    assert none.collect() == []


def test_calls_resolve_to_the_nearest_file(spark):
    texts = {
        "a.py": "from b import run\n\ndef run2():\n    run()\n    own()\n    lost()\n\ndef own():\n    pass\n",
        "b.py": "def run():\n    own()\n\ndef own():\n    run()\n",
        "c.py": "def run():\n    pass\n\ndef lost():\n    pass\n",
    }
    files = spark.createDataFrame(list(texts.items()), "filepath string, content string")
    rows = code_graph.resolved_calls(extract_blocks(files), code_graph.resolved_imports(files)).collect()
    assert sorted(tuple(r) for r in rows) == [
        ("a.py", "run2", "a.py", "own"), ("a.py", "run2", "b.py", "run"),
        ("b.py", "own", "b.py", "run"), ("b.py", "run", "b.py", "own"),
    ]
