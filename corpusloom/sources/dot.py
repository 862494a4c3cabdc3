"""Graph descriptions in DOT text."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = r'(?:"((?:[^"\\]|\\.)*)"|([A-Za-z_0-9.]+))'


def _name(line: Column, pattern: str, group: int) -> Column:
    quoted = F.regexp_extract(line, pattern, group)
    return F.when(quoted != "", quoted).otherwise(F.regexp_extract(line, pattern, group + 1))


def read_dot_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes(name, attributes map) and edges(src, dst) of a DOT file with one statement per line."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    edge_form = rf"^{_NAME}\s*->\s*{_NAME}"
    node_form = rf"^{_NAME}\s*(?:\[|;?$)"
    line = F.col("line")
    edges = lines.filter(line.rlike(edge_form)).select(
        _name(line, edge_form, 1).alias("src"), _name(line, edge_form, 3).alias("dst")
    ).distinct()
    declared = lines.filter(
        line.rlike(node_form) & ~line.rlike(edge_form) & ~line.rlike(r"^(?:graph|node|edge|digraph|subgraph|strict)\b")
    )
    body = F.regexp_extract(line, r"\[([\s\S]*)\]\s*;?$", 1)
    pattern = r'(\w+)\s*=\s*("(?:[^"\\]|\\.)*"|[^,\s\]]+)'
    keys = F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
    values = F.transform(
        F.regexp_extract_all(body, F.lit(pattern), F.lit(2)), lambda v: F.regexp_replace(v, r'^"|"$', "")
    )
    nodes = declared.select(
        _name(line, node_form, 1).alias("name"), F.map_from_arrays(keys, values).alias("attributes")
    )
    ends = edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct()
    bare = ends.join(nodes, "name", "left_anti").withColumn(
        "attributes", F.create_map().cast("map<string,string>")
    )
    return nodes.unionByName(bare), edges
