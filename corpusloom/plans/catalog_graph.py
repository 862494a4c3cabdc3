"""Registered queries: walks over the graph and its transforms."""

from pyspark.sql import functions as F

from corpusloom.operators import graph as ops
from corpusloom.plans.derived import graph_edges, graph_nodes, with_views
from corpusloom.plans.registry import query, table

DEPTH = 5


def _names(spark, sf_dir):
    return graph_nodes(spark, sf_dir).select("name")


@query(with_views("select src as name, dst as child from graph_edges", "graph_edges"))
def graph_children(spark, sf_dir):
    return ops.children(graph_edges(spark, sf_dir), _names(spark, sf_dir), graph_nodes(spark, sf_dir))


@query(with_views("select dst as name, src as parent from graph_edges", "graph_edges"))
def graph_parents(spark, sf_dir):
    return ops.parents(graph_edges(spark, sf_dir), _names(spark, sf_dir), graph_nodes(spark, sf_dir))


def _reach(a: str, b: str) -> str:
    return with_views(
        f""", r(source, node, depth) as (select {a}, {b}, 1 from graph_edges union
        select r.source, e.{b}, r.depth + 1 from r join graph_edges e on e.{a} = r.node where r.depth < {DEPTH})
        select source, node, min(depth)::int as hops from r group by 1, 2""",
        "graph_edges",
        recursive=True,
    )


@query(_reach("src", "dst"))
def children_by_depth(spark, sf_dir):
    starts = _names(spark, sf_dir).select(F.col("name").alias("source"))
    return ops.children_by_depth(graph_edges(spark, sf_dir), starts, DEPTH)


@query(_reach("dst", "src"))
def parents_by_depth(spark, sf_dir):
    starts = _names(spark, sf_dir).select(F.col("name").alias("source"))
    return ops.parents_by_depth(graph_edges(spark, sf_dir), starts, DEPTH)


@query(
    with_views(
        ", a as (select name from graph_nodes union select 'gone_' || p_name from part) "
        "select a.name, file_name, class_name from a left join graph_nodes using (name)",
        "graph_nodes",
    )
)
def node_lookup(spark, sf_dir):
    gone = table(spark, sf_dir, "part").select(F.concat(F.lit("gone_"), "p_name").alias("name"))
    return ops.node_lookup(graph_nodes(spark, sf_dir), _names(spark, sf_dir).union(gone))


@query(
    with_views(
        """, c as (select name, 0 as slot, name as v from graph_nodes union all select name, 1, file_name from graph_nodes
        union all select name, 2, class_name from graph_nodes where class_name is not null)
        select name, slot, levenshtein(v, 'ECONOMIC')::int as distance from c order by distance, name, slot limit 3""",
        "graph_nodes",
    )
)
def fuzzy_nodes(spark, sf_dir):
    return ops.fuzzy_nodes(graph_nodes(spark, sf_dir), "ECONOMIC", ("file_name", "class_name"))


def _walks(a: str, b: str, direction: str, levels: int | None, start: str) -> str:
    return f"""select name as root, [name, e.{b}] as path, e.{b} as node, 1 as depth, '{direction}' as direction,
        e.{b} = name as is_cycle from ({start}) s join graph_edges e on e.{a} = s.name
        union all select w.root, list_append(w.path, e.{b}), e.{b}, w.depth + 1, w.direction, list_contains(w.path, e.{b})
        from {{w}} w join graph_edges e on e.{a} = w.node where {f"w.depth < {levels} and" if levels else ""} not w.is_cycle"""


_WALK_COLUMNS = "root, array_to_string(path, '>') as path, node, depth, direction, is_cycle"


def _flat(walks):
    return walks.withColumn("path", F.array_join("path", ">"))


@query(
    with_views(
        ", d as ("
        + _walks("src", "dst", "children", 3, "select name from graph_nodes").format(w="d")
        + "), u as ("
        + _walks("dst", "src", "parents", 2, "select name from graph_nodes").format(w="u")
        + f") select {_WALK_COLUMNS} from d union all select {_WALK_COLUMNS} from u",
        "graph_nodes",
        "graph_edges",
        recursive=True,
    )
)
def node_hierarchy(spark, sf_dir):
    return _flat(ops.node_hierarchy(graph_edges(spark, sf_dir), _names(spark, sf_dir), 3, 2))


@query(
    with_views(
        ", d as ("
        + _walks(
            "src", "dst", "children", None, "select name from graph_nodes where name not in (select dst from graph_edges)"
        ).format(w="d")
        + f") select {_WALK_COLUMNS} from d",
        "graph_nodes",
        "graph_edges",
        recursive=True,
    )
)
def hierarchy_from_roots(spark, sf_dir):
    return _flat(ops.hierarchy_from_roots(graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir)))


@query(
    with_views(
        "select distinct a.class_name as src, b.class_name as dst from graph_edges e join graph_nodes a on a.name = e.src "
        "join graph_nodes b on b.name = e.dst where a.class_name <> b.class_name",
        "graph_nodes",
        "graph_edges",
    )
)
def quotient_graph(spark, sf_dir):
    return ops.quotient_graph(graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir), "class_name")


@query(with_views("select distinct file_name as name from graph_nodes where file_name <> ''", "graph_nodes"))
def quotient_nodes(spark, sf_dir):
    return ops.quotient_nodes(graph_nodes(spark, sf_dir), "file_name")


@query(
    with_views(
        "select name from graph_nodes where name not in (select dst from graph_edges)", "graph_nodes", "graph_edges"
    )
)
def graph_roots(spark, sf_dir):
    return ops.roots(graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir))


@query(with_views("select src, dst from graph_edges where src <> 'f_1' and dst <> 'f_1'", "graph_edges"))
def graph_without_root(spark, sf_dir):
    return ops.drop_node(graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir), "f_1")[1]


@query(
    "select p_partkey, case p_partkey % 3 when 0 then p_name || '_' || p_size when 1 then p_name else p_brand end as label "
    "from part"
)
def clean_label(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    label = F.expr(
        "case p_partkey % 3 when 0 then p_partkey || ': ' || p_name || '_' || p_size || '() ' "
        "when 1 then p_partkey || ':  ' || p_name || ' ' else ' ' || p_brand end"
    )
    return part.select("p_partkey", ops.clean_label(label).alias("label"))


@query(
    with_views(
        "select distinct a.file_name || '.' || coalesce(a.class_name, '') as src, b.file_name || '.' || "
        "coalesce(b.class_name, '') as dst from graph_edges e join graph_nodes a on a.name = e.src "
        "join graph_nodes b on b.name = e.dst",
        "graph_nodes",
        "graph_edges",
    )
)
def relabel_graph(spark, sf_dir):
    label = F.concat("file_name", F.lit("."), F.coalesce("class_name", F.lit("")))
    mapping = graph_nodes(spark, sf_dir).select("name", label.alias("label"))
    return ops.relabel(graph_edges(spark, sf_dir), mapping)


@query(
    """select p_partkey, case when p_partkey % 3 <> 0 then p_brand end as file_name,
    case when p_partkey % 3 = 1 then 'pkg.' || p_type end as class_name, 'f_' || p_partkey as function_name from part"""
)
def split_qualified_name(spark, sf_dir):
    name = F.expr(
        "case p_partkey % 3 when 0 then 'f_' || p_partkey when 1 then p_brand || '::pkg.' || p_type || '.f_' || p_partkey "
        "else p_brand || '::f_' || p_partkey end"
    )
    nodes = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.lit("box").alias("shape"))
    return ops.split_qualified_name(nodes).drop("name")
