"""Directed graphs as two tables: nodes(name, attributes...) and edges(src, dst)."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.rows import listed
from corpusloom.session import cut_lineage

CYCLE = "CYCLE"  # fixed value
#: Sources that walk together are the bits of a long: two to this power.
BLOCK_BITS = 6
#: Edges of a node that meet its walks in one group of the join; a node with more is split.
HUB_EDGES = 10_000


def _reversed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def require_nodes(nodes: DataFrame, asked: DataFrame, column: str = "name") -> DataFrame:
    """The asked names; a name that is no node is an error when the row is read."""
    known = nodes.select(F.col("name").alias(column)).distinct().withColumn("_known", F.lit(True))
    checked = asked.join(known, column, "left")
    message = F.concat(F.lit("Node with name '"), F.col(column), F.lit("' not found in the graph."))
    return checked.filter(
        F.coalesce("_known", F.raise_error(message).cast("boolean"))
    ).drop("_known")


def children(edges: DataFrame, asked: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """G1: (name, child) for every asked ``name``."""
    start = require_nodes(nodes, asked) if nodes is not None else asked
    return (
        start.select(F.col("name").alias("src"))
        .distinct()
        .join(edges.select("src", "dst").distinct(), "src")
        .select(F.col("src").alias("name"), F.col("dst").alias("child"))
    )


def parents(edges: DataFrame, asked: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(name, parent) for every asked ``name``."""
    return children(_reversed(edges), asked, nodes).withColumnRenamed("child", "parent")


def _steps(edges: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """Distinct edges with ``_part``, and (src, _parts) of hubs: nodes with more than ``span`` edges, split by edge.

    The edges are written once, as every hop reads them.
    """
    steps = cut_lineage(edges.select("src", "dst").distinct())
    degrees = steps.groupBy("src").agg(F.count(F.lit(1)).alias("_edges")).where(F.col("_edges") > span)
    hubs = listed(degrees.select("src", F.ceil(F.col("_edges") / span).cast("int").alias("_parts")))
    parted = steps.join(hubs, "src", "left").withColumn(
        "_part", F.pmod(F.xxhash64("dst"), F.coalesce("_parts", F.lit(1))).cast("int")
    )
    return parted.drop("_parts"), hubs


def within_depth(edges: DataFrame, starts: DataFrame, depth: int | None, span: int = HUB_EDGES) -> DataFrame:
    """(source, node, hops): nodes within ``depth`` hops of each ``source``, each once at its smallest number of
    hops; the source itself only when a cycle leads back to it. No depth means until nothing new is found.

    Sources are numbered and walk in blocks of 64: a row holds the sources of a block that have come to a node as the bits of a
    long, so walks that meet go on as one row. A hop is a join with the edges and a sum by bitwise or, in which what
    was seen before takes part as rows; it is checkpointed, which keeps the plan flat and survives lost executors.
    """
    steps, hubs = _steps(edges, span)
    numbered = cut_lineage(
        starts.select("source").distinct().sortWithinPartitions("source").withColumn("_id", F.monotonically_increasing_id())
    ).select(
        "source",
        F.shiftright("_id", BLOCK_BITS).alias("_block"),
        F.col("_id").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int").alias("_bit"),
    )
    none = F.lit(0).cast("long")
    state = numbered.select(
        "_block",
        F.col("source").alias("node"),
        none.alias("_seen"),
        F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit")).alias("_fresh"),
    )
    levels = state.select("_block", "node", "_fresh", F.lit(0).alias("hops")).limit(0)
    hop = 0
    while depth is None or hop < depth:
        hop += 1
        going = (
            state.where(F.col("_fresh") != 0)
            .select("_block", F.col("node").alias("src"), "_fresh")
            .join(hubs, "src", "left")
            .withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        )
        reached = going.join(steps, ["src", "_part"]).select(
            "_block", F.col("dst").alias("node"), none.alias("_seen"), F.col("_fresh").alias("_got")
        )
        merged = (
            state.select("_block", "node", "_seen", none.alias("_got"))
            .unionByName(reached)
            .groupBy("_block", "node")
            .agg(F.bit_or("_seen").alias("_seen"), F.bit_or("_got").alias("_got"))
        )
        state = cut_lineage(
            merged.select(
                "_block",
                "node",
                F.col("_seen").bitwiseOR(F.col("_got")).alias("_seen"),
                F.col("_got").bitwiseAND(F.bitwise_not("_seen")).alias("_fresh"),
            ).where(F.col("_seen") != 0)
        )
        fresh = state.where(F.col("_fresh") != 0)
        if hop != depth and fresh.isEmpty():
            break
        levels = levels.unionByName(fresh.select("_block", "node", "_fresh", F.lit(hop).alias("hops")))
    members = numbered.groupBy("_block").agg(F.collect_list(F.struct("_bit", "source")).alias("_members"))
    here = F.filter("_members", lambda m: F.getbit(F.col("_fresh"), m["_bit"]) == 1)
    return levels.join(members, "_block").select(F.explode(F.transform(here, lambda m: m["source"])).alias("source"), "node", "hops")


def children_by_depth(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Nodes reached along the edges within 1..depth hops; none when depth is below 1."""
    return within_depth(edges, starts, max(depth, 0))


def parents_by_depth(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Nodes that lead to the source within 1..depth hops."""
    return within_depth(_reversed(edges), starts, max(depth, 0))


def node_lookup(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """Attributes of each asked name, NULL when there is no such node."""
    return asked.select("name").distinct().join(nodes, "name", "left")


def fuzzy_nodes(
    nodes: DataFrame, term: str, attributes: Sequence[str], k: int = 3, distinct_nodes: bool = False
) -> DataFrame:
    """Closest candidates by edit distance, where the name and each attribute are candidates of their own."""
    slots = F.array(
        *[
            F.struct(F.lit(i).alias("slot"), F.col(c).alias("candidate"))
            for i, c in enumerate(("name", *attributes))
        ]
    )
    rated = (
        nodes.select("name", F.explode(slots).alias("s"))
        .filter(F.col("s.candidate").isNotNull())
        .select("name", "s.slot", F.levenshtein(F.col("s.candidate"), F.lit(term)).alias("distance"))
    )
    if distinct_nodes:
        rated = rated.groupBy("name").agg(F.min(F.struct("distance", "slot")).alias("b")).select(
            "name", "b.slot", "b.distance"
        )
    return rated.orderBy("distance", "name", "slot").limit(k)


def _expand_paths(
    edges: DataFrame, starts: DataFrame, levels: int | None, direction: str
) -> DataFrame:
    """(root, path, node, depth, direction, is_cycle): every walk from a root until a node repeats on it."""
    steps = (edges if direction == "children" else _reversed(edges)).select("src", "dst").distinct()
    return _walks(cut_lineage(steps), starts, levels, direction)


def _walks(steps: DataFrame, starts: DataFrame, levels: int | None, direction: str) -> DataFrame:
    """``_expand_paths`` over written distinct edges.

    Walks are as many as the graph has, by definition of the result; every hop is one join and is checkpointed. A hop is a
    join by shuffle: what the engine may broadcast passes the driver, with every hop anew.
    """
    steps = steps.hint("merge")
    walk = starts.select(
        F.col("name").alias("root"), F.array("name").alias("path"), F.col("name").alias("node")
    )
    out = None
    depth = 0
    while levels is None or depth < levels:
        depth += 1
        grown = cut_lineage(
            walk.join(steps, walk["node"] == steps["src"]).select(
                "root",
                F.concat("path", F.array("dst")).alias("path"),
                F.col("dst").alias("node"),
                F.lit(depth).alias("depth"),
                F.lit(direction).alias("direction"),
                F.array_contains("path", F.col("dst")).alias("is_cycle"),
            )
        )
        if grown.isEmpty():
            return out if out is not None else grown
        out = grown if out is None else out.unionByName(grown)
        walk = grown.filter(~F.col("is_cycle")).select("root", "path", "node")
    if out is None:
        out = walk.limit(0).select(
            "root",
            "path",
            "node",
            F.lit(0).alias("depth"),
            F.lit(direction).alias("direction"),
            F.lit(False).alias("is_cycle"),
        )
    return out


def node_hierarchy(
    edges: DataFrame, starts: DataFrame, child_levels: int | None = None, parent_levels: int | None = None
) -> DataFrame:
    """Walks down and up from each ``name`` to a level; a node already on its walk is marked and not expanded."""
    sides = []
    if child_levels is not None:
        sides.append(_expand_paths(edges, starts, child_levels, "children"))
    if parent_levels is not None:
        sides.append(_expand_paths(edges, starts, parent_levels, "parents"))
    if not sides:
        raise ValueError("give child_levels or parent_levels")
    return sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes no edge leads to."""
    return nodes.select("name").distinct().join(
        edges.select(F.col("dst").alias("name")).distinct().hint("merge"), "name", "left_anti"
    )


def drop_node(nodes: DataFrame, edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The graph without one node and its edges."""
    kept = edges.filter((F.col("src") != name) & (F.col("dst") != name))
    return nodes.filter(F.col("name") != name), kept


def hierarchy_from_roots(nodes: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Full expansion from every root, to ``max_depth`` levels if one is given. Walks end at a repeated node."""
    steps = cut_lineage(edges.select("src", "dst").distinct())  # every hop and the roots read them
    return _walks(steps, roots(nodes, steps), max_depth, "children")


def quotient_nodes(nodes: DataFrame, attribute: str) -> DataFrame:
    """Distinct non-empty values of the attribute."""
    value = F.col(attribute)
    return nodes.filter(value.isNotNull() & (value != "")).select(value.alias("name")).distinct()


def quotient_graph(nodes: DataFrame, edges: DataFrame, attribute: str) -> DataFrame:
    """Edges between attribute values; no edge from a value to itself."""
    value = nodes.filter(F.col(attribute).isNotNull() & (F.col(attribute) != "")).select(
        "name", F.col(attribute).alias("value")
    )
    source = value.select(F.col("name").alias("src"), F.col("value").alias("a"))
    target = value.select(F.col("name").alias("dst"), F.col("value").alias("b"))
    return (
        edges.join(source, "src")
        .join(target, "dst")
        .filter(F.col("a") != F.col("b"))
        .select(F.col("a").alias("src"), F.col("b").alias("dst"))
        .distinct()
    )


def clean_label(label: Column) -> Column:
    """``12: foo()`` -> ``foo``."""
    parts = F.split(label, ":")
    second = F.get(parts, F.lit(1))
    name = F.when(F.size(parts) > 1, F.get(F.split(second, r"\(\)"), F.lit(0))).otherwise(label)
    return F.regexp_replace(name, r"^\s+|\s+$", "")


def relabel(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges over new labels; nodes with equal labels merge. ``mapping`` is (name, label)."""
    source = mapping.select(F.col("name").alias("src"), F.col("label").alias("a"))
    target = mapping.select(F.col("name").alias("dst"), F.col("label").alias("b"))
    return (
        edges.join(source, "src")
        .join(target, "dst")
        .select(F.col("a").alias("src"), F.col("b").alias("dst"))
        .distinct()
    )


def split_qualified_name(nodes: DataFrame, column: str = "name") -> DataFrame:
    """``file::Class.func`` -> file_name, class_name, function_name; drawing attributes are dropped."""
    parts = F.split(F.col(column), "::")
    tail = F.get(parts, F.lit(1))
    split = F.size(parts) > 1
    owner = F.regexp_extract(tail, r"^([\s\S]*)\.[^.]*$", 1)
    return (
        nodes.drop("shape", "style", "fillcolor")
        .withColumn("file_name", F.when(split, F.get(parts, F.lit(0))))
        .withColumn("class_name", F.when(split & (owner != ""), owner))
        .withColumn(
            "function_name",
            F.when(split, F.regexp_extract(tail, r"([^.]*)$", 1)).otherwise(F.get(parts, F.lit(0))),
        )
    )

