"""Views derived from the given tables: source files, an earlier index, a graph, model replies.

Each view is a set of SQL expressions that Spark and an ANSI engine read alike; ``with_views`` puts them in front of
a SQL text as common table expressions.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.rows import spread
from corpusloom.plans.registry import table

K = "cast(p_partkey as string)"
S = "cast(p_size as string)"
NL = "chr(10)"


def _lines(*parts: str) -> str:
    return " || ".join(parts)


PY_FUNCTION = _lines("'def f_'", K, "'(a, b='", S, "') -> int:'", NL, "'    return a + b'")
PY_METHOD = _lines("'def m_'", K, "'(self):'", NL, "'        pass'")
PY_CLASS = _lines("'class C_'", K, "'(Base_'", S, "'):'", NL, "'    '", PY_METHOD)
PHP_FUNCTION = _lines("'function f_'", K, "'($a): int {'", NL, "'    return $a;'", NL, "'}'")
PHP_METHOD = _lines("'public function m_'", K, "'() {'", NL, "'        return;'", NL, "'    }'")
PHP_CLASS = _lines("'class C_'", K, "' extends Base_'", S, "' {'", NL, "'    '", PHP_METHOD, NL, "'}'")
TS_FUNCTION = _lines("'function f_'", K, "'(a: number): number {'", NL, "'    return a;'", NL, "'}'")

CODE_FILES = {
    "file_id": "p_partkey",
    "path": "'src/' || case p_partkey % 3 when 0 then 'core' when 1 then '.hidden' else 'build/out' end || '/m_' || "
    f"{K} || case p_partkey % 5 when 0 then '.py' when 1 then '.php' when 2 then '.ts' when 3 then '.sql' else '.md' end",
    "content": "case p_partkey % 5 "
    f"when 0 then {_lines(chr(39) + 'import os' + chr(39), NL, NL, PY_FUNCTION, NL, NL, PY_CLASS, NL)} "
    f"when 1 then {_lines(chr(39) + '<?php' + chr(39), NL, PHP_FUNCTION, NL, PHP_CLASS, NL)} "
    f"when 2 then {_lines(chr(39) + 'const x = ' + chr(39), S, chr(39) + ';' + chr(39), NL, TS_FUNCTION, NL)} "
    f"when 3 then 'SELECT * FROM t_' || {K} || ';' || {NL} || 'INSERT INTO t_' || {S} || ' VALUES (1, 2);' || {NL} "
    f"else '# ' || p_name || {NL} end",
}

INDEX_PREV = {
    "filepath": "path",
    "file_checksum": "md5(case when file_id % 11 = 0 then content || 'old' else content end)",
    "function_name": "'block_' || cast(file_id as string)",
    "embedding_model": "case when file_id % 977 = 0 then 'old-model' else 'current-model' end",
}
INDEX_PREV_ROWS = "file_id % 7 <> 0 and path not like '%.md'"
INDEX_GONE = {
    "filepath": "'src/core/removed_' || cast(file_id as string) || '.py'",
    "file_checksum": "md5('removed' || cast(file_id as string))",
    "function_name": "'gone'",
    "embedding_model": "'current-model'",
}
INDEX_GONE_ROWS = "file_id % 100 = 0"

GRAPH_NODES = {
    "name": f"'f_' || {K}",
    "file_name": "p_brand",
    "class_name": "case when p_size % 4 = 0 then null else p_type end",
}
AGENT_REPLIES = {
    "conv_id": "conv_id",
    "turn": "turn",
    "role": "role",
    "content": "case turn % 4 when 0 then 'ANSWER: True' || chr(10) || 'EXPLANATION: ' || text "
    "when 1 then 'I looked it up. ANSWER: ' || text "
    "when 2 then 'plan:' || chr(10) || '- one' || chr(10) || '- two' || chr(10) || '* three' || chr(10) || "
    "repeat(chr(96), 3) || 'python' || chr(10) || 'x = ' || cast(conv_id as string) || chr(10) || repeat(chr(96), 3) "
    "else text end",
    "function_call_name": "case when role = 'assistant' and turn % 3 = 1 then 'semantic_search' end",
}


def _select(columns: dict[str, str], source: str, where: str = "") -> str:
    listed = ", ".join(f"{expr} as {name}" for name, expr in columns.items())
    return f"select {listed} from {source}" + (f" where {where}" if where else "")


def _block(ordinal, language, kind, fn, cls, code, inputs, outputs, first, last, owner, summary, rest) -> str:
    columns = {
        "path": CODE_FILES["path"],
        "ordinal": str(ordinal),
        "language": f"'{language}'",
        "code_type": f"'{kind}'",
        "function_name": fn,
        "class_name": cls,
        "code": code,
        "inputs": inputs,
        "outputs": outputs,
        "start_line": first,
        "end_line": last,
        "owner_class": owner,
        "summary": summary,
    }
    return _select(columns, "part", f"p_partkey % 5 = {rest}")


def _summary(method_inputs: str) -> str:
    return (
        f"'class: C_' || {K} || chr(10) || '    parent classes: (''Base_' || {S} || ''',)' || chr(10) || chr(10) || "
        f"'    method: m_' || {K} || chr(10) || '        input parameters: {method_inputs}' || chr(10) || "
        "'        output parameters: None' || chr(10) || '        code: ...' || chr(10)"
    )


_F, _M, _C, _B = (f"'{p}_' || {K}" for p in ("f", "m", "C", "x"))
_BASE = f"'Base_' || {S}"
N = "null"

# the blocks the source files above consist of
CODE_BLOCKS = " union all ".join(
    [
        _block(0, "python", "class", N, _C, PY_CLASS, _BASE, N, 5, 7, N, _summary("(''self'',)"), 0),
        _block(1, "python", "function", _F, N, PY_FUNCTION, f"'a|b=' || {S}", "'int'", 2, 3, N, N, 0),
        _block(2, "python", "function", _M, N, PY_METHOD, "'self'", N, 6, 7, _C, N, 0),
        _block(3, "python", "global", N, N, "'import os' || chr(10) || chr(10) || chr(10)", N, N, N, N, N, N, 0),
        _block(0, "php", "class", N, _C, PHP_CLASS, _BASE, N, 4, 8, N, _summary("None"), 1),
        _block(1, "php", "function", _F, N, PHP_FUNCTION, "'$a'", "'int'", 1, 3, N, N, 1),
        _block(2, "php", "function", _M, N, PHP_METHOD, N, N, 5, 7, _C, N, 1),
        _block(3, "php", "global", N, N, "'<?php' || chr(10)", N, N, N, N, N, N, 1),
        _block(0, "typescript", "function", _F, N, TS_FUNCTION, "'a: number'", "'number'", 1, 3, N, N, 2),
        _block(1, "typescript", "global", N, N, f"'const x = ' || {S} || ';' || chr(10)", N, N, N, N, N, N, 2),
        _block(0, "sql", "select", N, N, f"'SELECT * FROM t_' || {K}", N, N, 0, 0, N, N, 3),
        _block(1, "sql", "insert", N, N, f"'INSERT INTO t_' || {S} || ' VALUES (1, 2)'", N, N, 1, 1, N, N, 3),
    ]
)

GRAPH_EDGES = (
    "select 'f_' || cast(a as string) as src, 'f_' || cast(b as string) as dst from ("
    "select p_partkey as a, p_partkey * 2 as b from part where p_partkey > 0 "
    "union select p_partkey, p_partkey * 2 + 1 from part where p_partkey > 0 "
    "union select p_partkey, cast(floor(p_partkey / 4) as bigint) from part where p_partkey > 0 and p_partkey % 64 = 0"
    ") e where b in (select p_partkey from part)"
)

TOKEN_RE = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"

VIEWS = {
    "code_files": _select(CODE_FILES, "part"),
    "code_index_prev": _select(INDEX_PREV, "code_files", INDEX_PREV_ROWS)
    + " union all "
    + _select(INDEX_GONE, "code_files", INDEX_GONE_ROWS),
    "code_blocks": CODE_BLOCKS,
    "graph_nodes": _select(GRAPH_NODES, "part"),
    "graph_edges": GRAPH_EDGES,
    "agent_replies": _select(AGENT_REPLIES, "conversations"),
}


def with_views(sql: str, *views: str, recursive: bool = False) -> str:
    """The SQL text behind the named views; ``sql`` may go on with further CTEs after a leading comma."""
    head = "with recursive " if recursive else "with "
    body = ", ".join(f"{v} as ({VIEWS[v]})" for v in views)
    return f"{head}{body} {sql}"


def _columns(columns: dict[str, str]) -> list[str]:
    return [f"{expr} as {name}" for name, expr in columns.items()]


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cutting a file costs far more than its row, so the rows of ``part`` are dealt to all cores first."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return spread(part).selectExpr(*_columns(CODE_FILES))


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files in the form the index reads."""
    return code_files(spark, sf_dir).select(
        F.lit("repo").alias("repo_id"), F.col("path").alias("filepath"), "content"
    )


def code_index_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = code_files(spark, sf_dir)
    kept = files.filter(INDEX_PREV_ROWS).selectExpr(*_columns(INDEX_PREV))
    return kept.unionByName(files.filter(INDEX_GONE_ROWS).selectExpr(*_columns(INDEX_GONE)))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*_columns(GRAPH_NODES))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"))
    a = F.col("a")
    targets = F.array(a * 2, a * 2 + 1, F.when(a % 64 == 0, F.floor(a / 4)))
    pairs = part.filter(a > 0).select("a", F.explode(targets).alias("b")).filter(F.col("b").isNotNull())
    known = part.select(a.alias("b")).hint("merge")  # all keys: a broadcast would pass the driver
    return (
        pairs.join(known, "b", "left_semi")
        .select(F.concat(F.lit("f_"), F.col("a").cast("string")).alias("src"), F.concat(F.lit("f_"), F.col("b").cast("string")).alias("dst"))
        .distinct()
    )


def agent_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(*_columns(AGENT_REPLIES))
