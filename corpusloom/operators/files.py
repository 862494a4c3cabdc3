"""File listings: pruning, trees, handlers, languages, lookups."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import (
    IgnoreRule,
    base_name,
    directory,
    directory_prefixes,
    ignored,
    suffix,
)
from corpusloom.operators.language_names import LANGUAGE_BY_ENDING, LANGUAGE_BY_NAME
from corpusloom.operators.languages import DEFAULT_LANGUAGES, language_of

# fixed values: messages of the path lookup
NOT_FOUND = "File not found: "
IS_DIRECTORY = "This is not a file, but a directory, pass a filepath instead: "
UNKNOWN_LANGUAGE = "Unknown language for file extension: "


def _pruned(path: Column, rules: list[IgnoreRule]) -> Column:
    return F.exists(
        directory_prefixes(path),
        lambda d: base_name(d).startswith(".") | ignored(F.concat(d, F.lit("/")), rules),
    )


def prune_dirs(files: DataFrame, rules: list[IgnoreRule], path: str = "path") -> DataFrame:
    """A2: drop files below a hidden or ignored directory; rules apply to directories only."""
    return files.filter(~_pruned(F.col(path), rules))


def list_repo_files(files: DataFrame, rules: list[IgnoreRule], path: str = "path") -> DataFrame:
    """A3: pruned listing without hidden or ignored files, as (dir, file, path)."""
    p = F.col(path)
    kept = prune_dirs(files, rules, path).filter(~base_name(p).startswith(".") & ~ignored(p, rules))
    return kept.select(directory(p).alias("dir"), base_name(p).alias("file"), p.alias("path"))


def sort_listing(listing: DataFrame) -> DataFrame:
    """Order of a listing: by directory, then by file."""
    return listing.orderBy("dir", "file")


def tree_lines(files: DataFrame, path: str = "path", root: str = "") -> DataFrame:
    """A4: one line per directory and file, indented by depth; ordered by ``sort_key``.

    The key keeps a directory's own files ahead of its subdirectories.
    """
    p = F.col(path)
    dirs = F.array_union(F.array(F.lit("")), directory_prefixes(p))

    def key(d: Column) -> Column:
        return F.when(d == "", F.lit("")).otherwise(F.concat(F.lit("/"), F.replace(d, F.lit("/"), F.lit("\u0002/"))))

    def depth(d: Column) -> Column:
        return F.when(d == "", 0).otherwise(F.size(F.split(d, "/")))

    d = F.col("d")
    name = F.when(d == "", F.lit(root)).otherwise(base_name(d))
    dir_lines = (
        files.select(F.explode(dirs).alias("d"))
        .distinct()
        .select(key(d).alias("sort_key"), F.concat(F.repeat(F.lit("    "), depth(d)), F.lit("/"), name).alias("line"))
    )
    own = directory(p)
    file_lines = files.select(
        F.concat(key(own), F.lit("\u0001"), base_name(p)).alias("sort_key"),
        F.concat(F.repeat(F.lit("    "), depth(own) + 1), base_name(p)).alias("line"),
    )
    return dir_lines.unionByName(file_lines)


def file_checksum(content: Column) -> Column:
    """A5: MD5 of the raw bytes."""
    return F.md5(content.cast("binary"))


def assign_handler(files: DataFrame, path: str = "path", languages=DEFAULT_LANGUAGES) -> DataFrame:
    """B1: handler by exact suffix, with a note where there is none. The note's wording is a fixed value."""
    p = F.col(path)
    handler = language_of(p, languages)
    note = F.concat(
        F.lit("No handler for files with extension "), suffix(p), F.lit(". Skipping file "), p
    )
    return files.withColumn("handler", handler).withColumn("note", F.when(F.col("handler").isNull(), note))


def detect_language(
    files: DataFrame,
    path: str = "path",
    by_name: dict[str, str] = LANGUAGE_BY_NAME,
    by_ending: dict[str, str] = LANGUAGE_BY_ENDING,
) -> DataFrame:
    """B2: display name of the language by the full file name, else by its ending, or a message naming the unknown
    ending. An ending may have several dots, and a key with a star is a pattern for the file name; where several fit, the
    last in the table counts. The two tables ship with the package, so the answer is the same on every machine."""
    base = base_name(F.col(path))
    places = {key: n for n, key in enumerate(by_ending)}
    endings = {key: n for key, n in places.items() if "*" not in key}
    patterns = {key: n for key, n in places.items() if "*" in key}

    def found(table: dict, key: Column) -> Column:
        if not table:
            return F.lit(None)
        pairs = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])
        return F.try_element_at(pairs, key)

    dots = max((key.count(".") for key in endings), default=0)
    fits = [found(endings, F.regexp_extract(base, rf"((?:\.[^.]*){{{n}}})\z", 1)) for n in range(1, dots + 1)]
    fits += [F.when(base.rlike("(?s)^" + ".*".join(map(re.escape, key.split("*"))) + r"\z"), n) for key, n in patterns.items()]
    last = F.array_max(F.array(*fits, F.lit(None).cast("int")))
    by_place = found(dict(enumerate(by_ending.values())), last)
    message = F.concat(F.lit(UNKNOWN_LANGUAGE), suffix(F.col(path)))
    return files.withColumn("language_name", F.coalesce(found(by_name, base), by_place, message))


def requested_text(requests: DataFrame, texts: DataFrame, value: str) -> DataFrame:
    """Text per requested path, or the message for a missing path or a directory."""
    asked = requests.select("filepath").distinct()
    known = texts.select("filepath", F.coalesce(F.col(value), F.lit("")).alias("_text"))
    dirs = texts.select(F.explode(directory_prefixes(F.col("filepath"))).alias("filepath")).distinct()
    hit = asked.join(known, "filepath", "left").join(dirs.withColumn("_dir", F.lit(True)), "filepath", "left")
    return hit.select(
        "filepath",
        F.when(F.col("_text").isNotNull(), F.col("_text"))
        .when(F.col("_dir"), F.concat(F.lit(IS_DIRECTORY), F.col("filepath")))
        .otherwise(F.concat(F.lit(NOT_FOUND), F.col("filepath")))
        .alias(value),
    )


def lookup_file_contents(
    requests: DataFrame, files: DataFrame, root: str = "", path: str = "path"
) -> DataFrame:
    """Raw text by path below the root or as given; messages for missing paths and directories."""
    prefix = root.rstrip("/") + "/" if root else ""
    asked = requests.select(F.col("filepath").alias("requested")).distinct()
    tries = asked.select(
        "requested",
        F.posexplode(F.array(F.concat(F.lit(prefix), "requested"), F.col("requested"))).alias("rank", "filepath"),
    )
    answers = requested_text(tries, files.select(F.col(path).alias("filepath"), "content"), "content")
    rated = tries.join(answers, "filepath").select(
        "requested",
        F.struct(
            F.when(F.col("content") == F.concat(F.lit(NOT_FOUND), F.col("filepath")), 2)
            .when(F.col("content") == F.concat(F.lit(IS_DIRECTORY), F.col("filepath")), 1)
            .otherwise(0)
            .alias("grade"),
            "rank",
            "content",
        ).alias("answer"),
    )
    best = rated.groupBy("requested").agg(F.min("answer").alias("answer"))
    grade = F.col("answer.grade")
    return best.select(
        F.col("requested").alias("filepath"),
        F.when(grade == 0, F.col("answer.content"))
        .when(grade == 1, F.concat(F.lit(IS_DIRECTORY), F.col("requested")))
        .otherwise(F.concat(F.lit(NOT_FOUND), F.col("requested")))
        .alias("content"),
    )


# fixed values: columns of a search answer, in order
SEARCH_COLUMNS = (
    "class_name",
    "function_name",
    "code",
    "code_type",
    "summary",
    "inputs",
    "outputs",
    "filepath",
)


def to_search_json(blocks: DataFrame, columns=SEARCH_COLUMNS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One JSON record per row, NULL fields kept."""
    record = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return blocks.select(*keep, record.alias("record"))


def simple_search(blocks: DataFrame, pattern: str, literal: bool = False, column: str = "code") -> DataFrame:
    """Rows whose code matches the regular expression, case-sensitive."""
    text = F.col(column)
    return blocks.filter(F.contains(text, F.lit(pattern)) if literal else text.rlike(pattern))


def preview(hits: DataFrame, lines: int = 7, key: str = "block_id") -> DataFrame:
    """Label and first lines of each hit."""
    label = F.format_string(
        "%s:%s  distance=%s", F.col("filepath"), F.col(key).cast("string"), F.round("similarities", 3).cast("string")
    )
    head = F.array_join(F.slice(F.split("code", "\n"), 1, lines), "\n")
    return hits.withColumn("label", label).withColumn("preview", head)


def attach_file_keys(files: DataFrame, content: str = "content") -> DataFrame:
    """Checksum beside each file, carried onto its blocks by the extraction."""
    return files.withColumn("file_checksum", file_checksum(F.col(content)))


def stamp_model(blocks: DataFrame, model: str) -> DataFrame:
    """The model column every row is indexed under."""
    return blocks.withColumn("embedding_model", F.lit(model))
