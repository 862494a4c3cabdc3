"""Registered queries: sources, files, incremental index."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.paths import compile_ignore_rules
from corpusloom.functions.rows import join_few
from corpusloom.operators import files as ops
from corpusloom.operators import index as idx
from corpusloom.operators.extract import extract_blocks, file_blocks, is_balanced
from corpusloom.operators.languages import language_of
from corpusloom.plans.derived import (
    code_files,
    code_index_prev,
    graph_edges,
    graph_nodes,
    repo_files,
    with_views,
)
from corpusloom.plans.refresh import refresh_index as refresh
from corpusloom.plans.registry import query, table
from corpusloom.schemas import INDEX
from corpusloom.session import scratch_path
from corpusloom.sources.documents import read_documents_csv, write_documents_csv
from corpusloom.sources.dot import read_dot_graph
from corpusloom.sources.files import scan_files as scan_tree
from corpusloom.sources.index_store import load_index, store_index

MODEL = "current-model"


def repo_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_blocks(ops.attach_file_keys(repo_files(spark, sf_dir)))


@query("select lang, doc_id, text from documents")
def scan_files(spark, sf_dir):
    """Files made of the documents, a line for each, found and read again with their contents."""
    path = scratch_path(spark, "tree")
    lines = table(spark, sf_dir, "documents").select("lang", F.to_json(F.struct("doc_id", "text")).alias("value"))
    lines.write.partitionBy("lang").text(path)
    files = scan_tree(spark, path, "part-*.txt")
    found = files.select(
        F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang"),
        F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line"),
    ).where("line <> ''")
    document = F.from_json("line", "doc_id bigint, text string").alias("d")
    return found.select("lang", document).select("lang", "d.doc_id", "d.text")


@query(
    with_views(
        "select path from code_files where path not like '%/.hidden/%' and path not like '%/build/%'", "code_files"
    )
)
def prune_dirs(spark, sf_dir):
    rules = compile_ignore_rules(["# output", "build/", "!build/keep/", "*.md"])
    return ops.prune_dirs(code_files(spark, sf_dir), rules).select("path")


@query(
    with_views(
        "select regexp_extract(path, '^(.*)/', 1) as dir, regexp_extract(path, '([^/]*)$', 1) as file, path "
        "from code_files where path not like '%/.hidden/%' and path not like '%.md'",
        "code_files",
    )
)
def list_repo_files(spark, sf_dir):
    rules = compile_ignore_rules(["/build/", "*.md"])
    return ops.list_repo_files(code_files(spark, sf_dir), rules)


@query(
    with_views(
        """, d as (select distinct unnest(['', 'src', regexp_extract(path, '^(src/[^/]*)/', 1),
              regexp_extract(path, '^(.*)/', 1)]) as d from code_files),
        k as (select d, case when d = '' then '' else '/' || replace(d, '/', chr(2) || '/') end as key,
              case when d = '' then 0 else len(string_split(d, '/')) end as depth from d)
        select key as sort_key, repeat('    ', depth) || '/' || regexp_extract(d, '([^/]*)$', 1) as line from k
        union all
        select k.key || chr(1) || regexp_extract(path, '([^/]*)$', 1),
               repeat('    ', k.depth + 1) || regexp_extract(path, '([^/]*)$', 1)
        from code_files join k on k.d = regexp_extract(path, '^(.*)/', 1)""",
        "code_files",
    )
)
def tree_lines(spark, sf_dir):
    return ops.tree_lines(code_files(spark, sf_dir))


@query(with_views("select path, md5(content) as file_checksum from code_files", "code_files"))
def file_checksum(spark, sf_dir):
    return code_files(spark, sf_dir).select("path", ops.file_checksum(F.col("content")).alias("file_checksum"))


@query(
    with_views(
        """, g as (select count(*) filter (where embedding_model <> 'current-model') as bad from code_index_prev)
        select 'all' as gate, filepath, file_checksum from code_index_prev, g where bad = 0
        union all select 'current', filepath, file_checksum from code_index_prev
        where embedding_model = 'current-model'""",
        "code_files",
        "code_index_prev",
    )
)
def load_index_gate(spark, sf_dir):
    index = code_index_prev(spark, sf_dir)
    passing = index.filter(F.col("embedding_model") == MODEL)
    columns = ("gate", "filepath", "file_checksum")
    whole = idx.model_gate(index, MODEL).withColumn("gate", F.lit("all")).select(*columns)
    return whole.unionByName(idx.model_gate(passing, MODEL).withColumn("gate", F.lit("current")).select(*columns))


@query(with_views("select path as filepath, ordinal, code from code_blocks", "code_blocks"))
def store_and_load_index(spark, sf_dir):
    rows = idx.append(spark.createDataFrame([], INDEX), repo_blocks(spark, sf_dir)).withColumn(
        "embedding_model", F.lit(MODEL)
    )
    path = scratch_path(spark, "index")
    store_index(rows, path)
    return load_index(spark, path, MODEL).select("filepath", "ordinal", "code")


@query(
    with_views(
        """, asked as (select path as filepath from code_files union select regexp_extract(path, '^(.*)/', 1) from code_files
              union select 'missing/' || p_name from part)
        select a.filepath, case when f.content is not null then f.content
          when a.filepath like 'missing/%' then 'File not found: ' || a.filepath
          else 'This is not a file, but a directory, pass a filepath instead: ' || a.filepath end as content
        from asked a left join code_files f on a.filepath = 'repo/' || f.path or a.filepath = f.path""",
        "code_files",
    )
)
def lookup_file_contents(spark, sf_dir):
    files = code_files(spark, sf_dir)
    asked = (
        files.select(F.col("path").alias("filepath"))
        .union(files.select(F.regexp_extract("path", "^(.*)/", 1)))
        .union(table(spark, sf_dir, "part").select(F.concat(F.lit("missing/"), "p_name")))
    )
    return ops.lookup_file_contents(asked, files, root="repo")


@query(
    with_views(
        """select path as filepath, ordinal, to_json({'class_name': class_name, 'function_name': function_name,
        'code': code, 'code_type': code_type, 'summary': summary, 'inputs': string_split(inputs, '|'),
        'outputs': string_split(outputs, '|'), 'filepath': path})::varchar as record from code_blocks""",
        "code_blocks",
    )
)
def to_search_json(spark, sf_dir):
    blocks = repo_blocks(spark, sf_dir).withColumn("path", F.col("filepath"))
    return ops.to_search_json(blocks, keep=("path", "ordinal")).withColumnRenamed("path", "filepath")


@query("select doc_id, text from documents")
def csv_documents_round_trip(spark, sf_dir):
    path = scratch_path(spark, "documents")
    write_documents_csv(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return read_documents_csv(spark, path, "doc_id bigint, text string")


@query(
    "select vec_id, i as dim, embedding[i]::double as value from embeddings, "
    "(select unnest(range(1, 65)) as i) r"
)
def csv_vectors_round_trip(spark, sf_dir):
    path = scratch_path(spark, "vectors")
    write_documents_csv(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), path, "embedding")
    rows = read_documents_csv(spark, path, "vec_id bigint, embedding string", "embedding")
    return rows.select("vec_id", F.posexplode("embedding").alias("pos", "x")).select(
        "vec_id", (F.col("pos") + 1).cast("long").alias("dim"), F.col("x").cast("float").cast("double").alias("value")
    )


def _dot_file(spark, sf_dir) -> str:
    path = scratch_path(spark, "dot")
    nodes = graph_nodes(spark, sf_dir).select(
        F.format_string('  "%s" [file="%s", class="%s"];', "name", "file_name", F.coalesce("class_name", F.lit("")))
    )
    edges = graph_edges(spark, sf_dir).select(F.format_string('  "%s" -> "%s" [color=black];', "src", "dst"))
    nodes.union(edges).toDF("value").write.text(path)
    return path


@query(with_views("select src, dst from graph_edges", "graph_edges"))
def dot_edges(spark, sf_dir):
    return read_dot_graph(spark, _dot_file(spark, sf_dir))[1]


@query(with_views("select name, file_name, coalesce(class_name, '') as class_name from graph_nodes", "graph_nodes"))
def dot_nodes(spark, sf_dir):
    nodes = read_dot_graph(spark, _dot_file(spark, sf_dir))[0]
    return nodes.select(
        "name", F.col("attributes")["file"].alias("file_name"), F.col("attributes")["class"].alias("class_name")
    )


_HANDLER = (
    "case regexp_extract(path, '(\\.[^./]*)$', 1) when '.py' then 'python' when '.php' then 'php' "
    "when '.ts' then 'typescript' when '.tsx' then 'typescript' when '.sql' then 'sql' end"
)


@query(
    with_views(
        f"select path, {_HANDLER} as handler, case when path like '%.md' then "
        "'No handler for files with extension .md. Skipping file ' || path end as note from code_files",
        "code_files",
    )
)
def assign_handler(spark, sf_dir):
    return ops.assign_handler(code_files(spark, sf_dir)).select("path", "handler", "note")


@query(
    """select p_partkey, p_name || '.' || lower(p_type) as name,
    'Unknown language for file extension: .' || lower(p_type) as language_name from part
    union all select p_partkey, 'a/' || p_name || case p_partkey % 3 when 0 then '.py' when 1 then '.ts' else '.sql' end,
    case p_partkey % 3 when 0 then 'Python' when 1 then 'TypeScript' else 'Transact-SQL' end from part
    union all select p_partkey, p_name || '/' || case p_partkey % 3 when 0 then 'Dockerfile' when 1 then 'Makefile' else 'x.h++' end,
    case p_partkey % 3 when 0 then 'Docker' when 1 then 'Makefile' else 'C++' end from part"""
)
def detect_language(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.selectExpr("p_partkey", "p_name || '.' || lower(p_type) as name").union(
        part.selectExpr(
            "p_partkey",
            "'a/' || p_name || case p_partkey % 3 when 0 then '.py' when 1 then '.ts' else '.sql' end as name",
        )
    ).union(
        part.selectExpr(
            "p_partkey",
            "p_name || '/' || case p_partkey % 3 when 0 then 'Dockerfile' when 1 then 'Makefile' else 'x.h++' end as name",
        )
    )
    return ops.detect_language(names, "name").select("p_partkey", "name", "language_name")


_STATUS = """, known as (select filepath, max(file_checksum) as stored from code_index_prev group by 1),
    changes as (select coalesce(f.path, k.filepath) as filepath, case when f.path is null then 'deleted'
      when k.stored is null then 'new' when k.stored <> md5(f.content) then 'changed' else 'unmodified' end as status
      from code_files f full join known k on k.filepath = f.path)"""


# Files that cannot be cut and files with nothing to cut, beside the others.
_ODD_FILES = {
    "broken": ("p_partkey % 10 = 0", "'broken/b_' || cast(p_partkey as string) || '.py'", "'def broken(:' || chr(10)"),
    "empty": ("p_partkey % 10 = 1", "'empty/e_' || cast(p_partkey as string) || '.py'", "''"),
}


@query(
    with_views(
        _STATUS.replace("from code_files f full", "from files f full").replace(
            ", known as",
            ", files as (select path, content from code_files"
            + "".join(f" union all select {path}, {text} from part where {where}" for where, path, text in _ODD_FILES.values())
            + "), known as",
        )
        + """, r as (select case when status = 'unmodified' then 'unmodified' when filepath like '%.md' then 'no_parser'
        when filepath like 'broken/%' then 'error' when filepath like 'empty/%' then 'no_blocks' else 'extracted' end as reason,
        filepath from changes where status <> 'deleted')
        select reason, count(*) as n_files, sum(case when reason <> 'extracted' then 0
          when filepath like '%.py' or filepath like '%.php' then 4 else 2 end)::bigint as n_blocks from r group by 1""",
        "code_files",
        "code_index_prev",
    )
)
def skip_reasons(spark, sf_dir):
    """Changes are tested first; only files that are new or changed, and sound, are cut."""
    files = repo_files(spark, sf_dir)
    for where, path, text in _ODD_FILES.values():
        odd = table(spark, sf_dir, "part").where(where)
        files = files.unionByName(odd.selectExpr("'repo' as repo_id", f"{path} as filepath", f"{text} as content"))
    language = language_of(F.col("filepath"))
    keyed = ops.attach_file_keys(files).select("filepath", "file_checksum", language.alias("handler"))
    changes = idx.detect_changes(keyed, code_index_prev(spark, sf_dir))
    todo = changes.filter((F.col("status") != "unmodified") & F.col("handler").isNotNull()).select("filepath")
    work = join_few(files.select("filepath", "content"), todo, ["filepath"], "left_semi")
    sound = work.select("filepath", "content", F.coalesce(is_balanced(F.col("content"), language), F.lit(True)).alias("sound"))
    cut = sound.select(
        "filepath",
        F.when(~F.col("sound"), F.lit("cannot be parsed")).alias("error"),
        F.when(F.col("sound"), F.coalesce(F.size(file_blocks()), F.lit(0))).alias("n_blocks"),
    )
    return idx.reason_counts(idx.skip_reason(changes.join(cut, "filepath", "left")))


@query("select doc_id, text from documents where regexp_matches(text, '[Tt]he [a-z]+ing\\b')")
def simple_search(spark, sf_dir):
    return ops.simple_search(
        table(spark, sf_dir, "documents").select("doc_id", "text"), r"[Tt]he [a-z]+ing\b", column="text"
    )


@query(with_views("select path as filepath, ordinal, code from code_blocks where contains(code, '(self):')", "code_blocks"))
def literal_search(spark, sf_dir):
    return ops.simple_search(repo_blocks(spark, sf_dir), "(self):", literal=True).select(
        "filepath", "ordinal", "code"
    )


@query(
    with_views(
        "select b.path as filepath, ordinal, md5(f.content) as file_checksum, 'current-model' as embedding_model "
        "from code_blocks b join code_files f on b.path = f.path",
        "code_files",
        "code_blocks",
    )
)
def block_file_keys(spark, sf_dir):
    return ops.stamp_model(repo_blocks(spark, sf_dir), MODEL).select(
        "filepath", "ordinal", "file_checksum", "embedding_model"
    )


@query(
    with_views(
        _STATUS + " select filepath, status from changes where status <> 'deleted'", "code_files", "code_index_prev"
    )
)
def detect_changes(spark, sf_dir):
    files = ops.attach_file_keys(repo_files(spark, sf_dir)).select("filepath", "file_checksum")
    return idx.detect_changes(files, code_index_prev(spark, sf_dir)).select("filepath", "status")


@query(with_views(_STATUS + " select filepath, status from changes", "code_files", "code_index_prev"))
def detect_deleted(spark, sf_dir):
    files = ops.attach_file_keys(repo_files(spark, sf_dir)).select("filepath", "file_checksum")
    return idx.detect_changes(files, code_index_prev(spark, sf_dir), deleted=True).select("filepath", "status")


@query(
    with_views(
        "select md5(content) as file_checksum, min(path) as filepath from code_files group by 1", "code_files"
    )
)
def checksum_paths(spark, sf_dir):
    files = ops.attach_file_keys(repo_files(spark, sf_dir))
    return idx.checksum_paths(files).select("file_checksum", "filepath")


@query(
    with_views(
        _STATUS
        + """ select filepath, file_checksum, function_name from code_index_prev where file_checksum not in (
        select p.file_checksum from code_index_prev p join changes c on c.filepath = p.filepath
        where c.status = 'changed')""",
        "code_files",
        "code_index_prev",
    )
)
def drop_outdated(spark, sf_dir):
    index = code_index_prev(spark, sf_dir)
    files = ops.attach_file_keys(repo_files(spark, sf_dir)).select("filepath", "file_checksum")
    stale = (
        idx.detect_changes(files, index)
        .filter(F.col("status") == "changed")
        .select(F.col("stored_checksum").alias("file_checksum"))
    )
    return idx.drop_outdated(index, stale).select("filepath", "file_checksum", "function_name")


@query(
    with_views(
        "select filepath, function_name, embedding_model, null::int as ordinal from code_index_prev union all "
        "select path, function_name, null, ordinal from code_blocks",
        "code_files",
        "code_index_prev",
        "code_blocks",
    )
)
def append_index(spark, sf_dir):
    new = repo_blocks(spark, sf_dir).select("filepath", "function_name", "ordinal")
    return idx.append(code_index_prev(spark, sf_dir), new).select(
        "filepath", "function_name", "embedding_model", "ordinal"
    )


@query(
    with_views(
        """select filepath, file_checksum, function_name from code_index_prev
        where filepath in (select path from code_files)""",
        "code_files",
        "code_index_prev",
    )
)
def drop_deleted(spark, sf_dir):
    return idx.drop_deleted(code_index_prev(spark, sf_dir), repo_files(spark, sf_dir)).select(
        "filepath", "file_checksum", "function_name"
    )


_REFRESHED = (
    _STATUS
    + """ select p.filepath, p.file_checksum, p.function_name, null as code_type, p.embedding_model
    from code_index_prev p join changes c on c.filepath = p.filepath and {kept}
    union all
    select b.path, md5(f.content), b.function_name, b.code_type, 'current-model'
    from code_blocks b join code_files f on f.path = b.path join changes c on c.filepath = b.path
    where c.status in ('new', 'changed') and b.path not like '%/.hidden/%'"""
)
_REFRESH_VIEWS = ("code_files", "code_index_prev", "code_blocks")
# a hidden file is not listed, so its earlier rows stay unless deleted files are removed


def _refreshed(spark, sf_dir, remove_deleted):
    index = code_index_prev(spark, sf_dir).withColumn("repo_id", F.lit("repo"))
    fresh = refresh(repo_files(spark, sf_dir), index, MODEL, remove_deleted=remove_deleted)
    return fresh.select("filepath", "file_checksum", "function_name", "code_type", "embedding_model")


@query(
    with_views(
        _REFRESHED.format(kept="(c.status <> 'changed' or c.filepath like '%/.hidden/%')"), *_REFRESH_VIEWS
    )
)
def refresh_index(spark, sf_dir):
    return _refreshed(spark, sf_dir, False)


@query(
    with_views(
        _REFRESHED.format(kept="c.status = 'unmodified' and c.filepath not like '%/.hidden/%'"), *_REFRESH_VIEWS
    )
)
def refresh_index_removing(spark, sf_dir):
    return _refreshed(spark, sf_dir, True)
