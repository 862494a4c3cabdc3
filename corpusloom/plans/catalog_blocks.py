"""Registered queries: code blocks and the graphs derived from them."""

from pyspark.sql import functions as F

from corpusloom.functions.rows import explode_once
from corpusloom.operators import code_graph as graphs
from corpusloom.operators import extract as ops
from corpusloom.operators.languages import language_of
from corpusloom.plans.catalog_files import repo_blocks
from corpusloom.plans.derived import code_files, repo_files, with_views
from corpusloom.plans.registry import query, table

_COLUMNS = (
    "filepath",
    "ordinal",
    "language",
    "code_type",
    "function_name",
    "class_name",
    "code",
    "inputs",
    "outputs",
    "start_line",
    "end_line",
    "owner_class",
    "summary",
)
_SQL_COLUMNS = ", ".join("path as filepath" if c == "filepath" else c for c in _COLUMNS)


def _flat(blocks):
    return blocks.select(
        *[F.array_join(c, "|").alias(c) if c in ("inputs", "outputs") else c for c in _COLUMNS]
    )


def _blocks_sql(where: str = "true") -> str:
    return with_views(f"select {_SQL_COLUMNS} from code_blocks where {where}", "code_blocks")


@query(_blocks_sql())
def extract_blocks(spark, sf_dir):
    return _flat(repo_blocks(spark, sf_dir))


@query(_blocks_sql("code_type = 'function'"))
def function_blocks(spark, sf_dir):
    return _flat(ops.function_blocks(repo_blocks(spark, sf_dir)))


@query(_blocks_sql("code_type = 'class'"))
def class_blocks(spark, sf_dir):
    return _flat(ops.class_blocks(repo_blocks(spark, sf_dir)))


@query(_blocks_sql("owner_class is not null"))
def method_blocks(spark, sf_dir):
    return _flat(ops.method_blocks(repo_blocks(spark, sf_dir)))


@query(_blocks_sql("code_type = 'global'"))
def global_block(spark, sf_dir):
    return _flat(ops.global_block(repo_blocks(spark, sf_dir)))


@query(_blocks_sql("language = 'sql'"))
def sql_statements(spark, sf_dir):
    return _flat(ops.sql_statements(repo_blocks(spark, sf_dir)))


@query(
    with_views(
        "select path as filepath, ordinal, x as name, side from (select path, ordinal, "
        "unnest(string_split(inputs, '|')) as x, 'input' as side from code_blocks where code_type = 'function' "
        "union all select path, ordinal, outputs, 'output' from code_blocks where outputs is not null)",
        "code_blocks",
    )
)
def function_parameters(spark, sf_dir):
    blocks = ops.function_blocks(repo_blocks(spark, sf_dir))

    def of_side(column: str, side: str):
        names = F.coalesce(column, F.array().cast("array<string>"))
        return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(side).alias("side")))

    both = F.concat(of_side("inputs", "input"), of_side("outputs", "output"))
    both = explode_once(blocks, ["filepath", "ordinal"], both, "_at", "p")  # blocks are cut once for both sides
    return both.select("filepath", "ordinal", "p.name", "p.side")


@query(
    with_views(
        "select path as filepath, class_name, inputs as parent, summary from code_blocks where code_type = 'class'",
        "code_blocks",
    )
)
def class_summaries(spark, sf_dir):
    classes = ops.class_blocks(repo_blocks(spark, sf_dir))
    return classes.select("filepath", "class_name", F.array_join("inputs", "|").alias("parent"), "summary")


@query(
    with_views(
        "select path as filepath, coalesce(class_name, function_name) as name, start_line, end_line "
        "from code_blocks where language <> 'sql' and start_line is not null",
        "code_blocks",
    )
)
def spans(spark, sf_dir):
    blocks = repo_blocks(spark, sf_dir).filter(F.col("language") != "sql")
    return ops.spans(blocks).select("filepath", "name", "start_line", "end_line")


@query(
    with_views(
        "select path as filepath, code_type as name, start_line, end_line from code_blocks where language = 'sql'",
        "code_blocks",
    )
)
def sql_spans(spark, sf_dir):
    return ops.spans(ops.sql_statements(repo_blocks(spark, sf_dir))).select(
        "filepath", "name", "start_line", "end_line"
    )


_OUTLINE = """, asked as (select path as filepath from code_files union select 'missing/' || p_name from part)
    select a.filepath, case when f.path is null then 'File not found: ' || a.filepath
      when f.file_id % 5 = 0 then 'Class: C_' || f.file_id || chr(10) || chr(9) || 'Parent Classes: Base_' || p_size
        || chr(10) || chr(9) || 'method: m_' || f.file_id || chr(10) || 'Function: f_' || f.file_id || chr(10) || chr(9)
        || 'Input Parameters: a, b=' || p_size || chr(10) || chr(9) || 'Output Parameters: int' || chr(10)
        || 'Function: m_' || f.file_id || chr(10) || chr(9) || 'Input Parameters: self'
      when f.file_id % 5 = 1 then 'Class: C_' || f.file_id || chr(10) || chr(9) || 'Parent Classes: Base_' || p_size
        || chr(10) || chr(9) || 'method: m_' || f.file_id || chr(10) || 'Function: f_' || f.file_id || chr(10) || chr(9)
        || 'Input Parameters: $a' || chr(10) || chr(9) || 'Output Parameters: int' || chr(10)
        || 'Function: m_' || f.file_id
      when f.file_id % 5 = 2 then 'Function: f_' || f.file_id || chr(10) || chr(9) || 'Input Parameters: a: number'
        || chr(10) || chr(9) || 'Output Parameters: number'
      else '' end as outline
    from asked a left join code_files f on a.filepath = f.path left join part p on p.p_partkey = f.file_id"""


@query(with_views(_OUTLINE, "code_files"))
def summarize_files(spark, sf_dir):
    files = repo_files(spark, sf_dir)
    asked = files.select("filepath").union(
        table(spark, sf_dir, "part").select(F.concat(F.lit("missing/"), "p_name"))
    )
    return ops.summarize_files(files, asked)


@query(
    with_views(
        "select path as filepath, variant, case when path not like '%.md' then variant = 'whole' end as balanced "
        "from code_files, (select unnest(['whole', 'bracket', 'quote']) as variant) v",
        "code_files",
    )
)
def is_balanced(spark, sf_dir):
    files = code_files(spark, sf_dir)
    variants = F.array(
        F.struct(F.lit("whole").alias("variant"), F.col("content").alias("text")),
        F.struct(F.lit("bracket").alias("variant"), F.concat("content", F.lit("(")).alias("text")),
        F.struct(F.lit("quote").alias("variant"), F.concat("content", F.lit("\"\n")).alias("text")),
    )
    rows = files.select(F.col("path").alias("filepath"), F.explode(variants).alias("v"))
    return rows.select(
        "filepath",
        "v.variant",
        ops.is_balanced(F.col("v.text"), language_of(F.col("filepath"))).alias("balanced"),
    )


def _caller_blocks(spark, sf_dir):
    """Blocks of the source files plus one caller per file that calls its function and one of the next file."""
    files = code_files(spark, sf_dir)
    k = F.col("file_id")
    python = F.format_string(
        "def g_%s(x):\n    # f_0(x)\n    y = f_%s(x, 'f_1(x)')\n    return g_%s(y) + len(y) + unknown(y)\n", k, k, k + 5
    )
    php = F.format_string(
        "<?php\nfunction g_%s($x) {\n    // f_0($x);\n    $y = f_%s($x, 'f_1(x)');\n    return g_%s($y) + unknown($y);\n}\n",
        k, k, k + 5,
    )
    script = F.format_string(
        "function g_%s(x: number): number {\n    /* f_0(x) */\n    const y = f_%s(x, 'f_1(x)');\n"
        "    return g_%s(y) + unknown(y);\n}\n",
        k, k, k + 5,
    )
    path = F.col("path")
    content = (
        F.when(path.endswith(".py"), python)
        .when(path.endswith(".php"), php)
        .when(path.endswith(".ts"), script)
        .otherwise(F.col("content"))
    )
    return ops.extract_blocks(
        files.select(path.alias("filepath"), content.alias("content")).unionByName(
            files.select(path.alias("filepath"), "content")
        )
    )


@query(
    with_views(
        "select 'g_' || file_id as src, 'f_' || file_id as dst from code_files where file_id % 5 < 3 union "
        "select 'g_' || a.file_id, 'g_' || b.file_id from code_files a join code_files b on b.file_id = a.file_id + 5 "
        "where a.file_id % 5 < 3",
        "code_files",
    )
)
def call_graph(spark, sf_dir):
    return graphs.call_graph(_caller_blocks(spark, sf_dir))


def _importing_files(spark, sf_dir):
    """The source files; each imports the next one of its folder and language, and one of another folder, and calls.

    The second import is by whole name in Python and PHP, where the folder can be part of one, and relative in TypeScript.
    """
    k = F.col("file_id")
    near, far, other = k + 15, k + 5, k + 30
    folder = F.when(far % 3 == 0, "core").when(far % 3 == 1, ".hidden").otherwise("build/out")
    up = F.when(k % 3 == 2, "../../").otherwise("../")
    dotted = F.replace(folder, F.lit("/"), F.lit("."))
    backslashed = F.replace(folder, F.lit("/"), F.lit("\\"))
    python = F.concat(
        F.format_string("from .m_%s import f_%s\n", near, near),
        F.when(far % 3 != 1, F.format_string("import src.%s.m_%s as other\n", dotted, far)).otherwise(""),
        F.format_string("\ndef g_%s(x):\n    return f_%s(x) + f_%s(x) + f_%s(x) + unknown(x)\n", k, k, near, other),
    )
    php = F.concat(
        F.format_string("require_once 'm_%s.php';\n", near),
        F.when(far % 3 != 1, F.format_string("use src\\%s\\m_%s;\n", backslashed, far)).otherwise(""),
        F.format_string("function g_%s($x) {\n    return f_%s($x) + f_%s($x) + f_%s($x);\n}\n", k, k, near, other),
    )
    script = F.concat(
        F.format_string("import { f_%s } from './m_%s';\nimport * as other from '%s%s/m_%s';\n", near, near, up, folder, far),
        F.format_string("function g_%s(x: number): number {\n    return f_%s(x) + f_%s(x) + f_%s(x);\n}\n", k, k, near, other),
    )
    path = F.col("path")
    more = F.when(path.endswith(".py"), python).when(path.endswith(".php"), php).when(path.endswith(".ts"), script)
    return code_files(spark, sf_dir).select(
        path.alias("filepath"), F.concat("content", F.coalesce(more, F.lit(""))).alias("content")
    )


_IMPORTED = """, t as (select a.path as filepath, a.file_id as k, b.path as target, b.file_id as n
      from code_files a join code_files b on b.file_id - a.file_id in (5, 15)
      where a.file_id % 5 < 3 and (b.file_id - a.file_id = 15 or b.file_id % 3 <> 1 or a.file_id % 5 = 2))"""


@query(
    with_views(
        _IMPORTED
        + """ select filepath, case when k % 5 = 0 and n - k = 15 then '.m_' || n
          when k % 5 = 1 and n - k = 15 then 'm_' || n || '.php' when k % 5 = 2 and n - k = 15 then './m_' || n
          when k % 5 = 2 then case when k % 3 = 2 then '../../' else '../' end || target[5:-4]
          else replace(regexp_replace(target, '[.][a-z]+$', ''), '/', '.') end as module, target from t""",
        "code_files",
    )
)
def resolved_imports(spark, sf_dir):
    return graphs.resolved_imports(_importing_files(spark, sf_dir))


@query(
    with_views(
        _IMPORTED
        + """ select filepath, 'g_' || k as src, target, 'f_' || n as dst from t where n - k = 15
        union all select path, 'g_' || file_id, path, 'f_' || file_id from code_files where file_id % 5 < 3""",
        "code_files",
    )
)
def resolved_calls(spark, sf_dir):
    files = _importing_files(spark, sf_dir)
    return graphs.resolved_calls(ops.extract_blocks(files), graphs.resolved_imports(files))


@query(
    with_views(
        "select class_name as src, inputs as dst from code_blocks where code_type = 'class' union all "
        "select 'Base_' || p_size, 'Root' from part union select 'Root', 'object' from part",
        "code_blocks",
    )
)
def class_graph(spark, sf_dir):
    bases = code_files(spark, sf_dir).select(
        F.concat(F.lit("lib/b_"), F.col("file_id").cast("string"), F.lit(".py")).alias("filepath"),
        F.lit("").alias("content"),
    )
    sizes = table(spark, sf_dir, "part").select("p_size").distinct()
    texts = sizes.select(
        F.format_string("lib/base_%s.py", F.col("p_size")).alias("filepath"),
        F.format_string(
            "class Base_%s(pkg.Root, metaclass=Meta):\n    pass\n\nclass Root(object):\n    pass\n\nclass object:\n    pass\n",
            F.col("p_size"),
        ).alias("content"),
    )
    files = repo_files(spark, sf_dir).select("filepath", "content").unionByName(bases).unionByName(texts)
    return graphs.class_graph(ops.extract_blocks(files))


@query(
    with_views(
        "select distinct replace(regexp_extract(path, '^(.*)[.][a-z]+$', 1), '/', '.') as src, 'os' as dst "
        "from code_files where path like '%.py'",
        "code_files",
    )
)
def import_graph(spark, sf_dir):
    return graphs.import_graph(repo_files(spark, sf_dir))
