"""Graphs derived from blocks and files: calls, inheritance, imports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import suffix
from corpusloom.functions.rows import explode_once
from corpusloom.functions.text import bind
from corpusloom.operators.extract import mask
from corpusloom.operators.languages import DEFAULT_LANGUAGES, language_of
from corpusloom.session import cut_lineage

# fixed values: words that may stand before a parenthesis without being a call
NOT_CALLS = (
    "and", "array", "assert", "await", "catch", "def", "elif", "except", "for", "foreach", "function", "if",
    "in", "is", "isset", "lambda", "list", "not", "or", "print", "return", "super", "switch", "typeof", "while",
    "with", "yield",
)


def _masked(text: Column, language: Column, languages) -> Column:
    out = F.lit(None).cast("string")
    for spec in languages:
        out = F.when(language == spec.name, mask(text, spec)).otherwise(out)
    return out


def call_graph(blocks: DataFrame, scope: tuple[str, ...] = (), languages=DEFAULT_LANGUAGES) -> DataFrame:
    """(src, dst) from a function to every known function its code calls, within ``scope`` columns.

    Calls are reduced to distinct names per function in the row and to distinct pairs before the join.
    """
    functions = _functions(blocks, scope, languages)
    calls = _called_names(functions, scope)
    known = functions.select(*scope, F.col("src").alias("dst")).distinct()
    return calls.join(known, [*scope, "dst"], "left_semi").select(*scope, "src", "dst")


def _functions(blocks: DataFrame, scope: tuple[str, ...], languages) -> DataFrame:
    """(scope, src, names): every function with the names that it calls, known or not.

    Written once, as callers and known names both come from it and the blocks would be cut again for each.
    """

    def called(text: Column) -> Column:
        body = F.regexp_replace(text, r"^[^(]*\(", "(")
        names = F.array_distinct(F.regexp_extract_all(body, F.lit(r"([A-Za-z_$][\w$]*)\s*\("), F.lit(1)))
        return F.filter(names, lambda n: ~n.isin(*NOT_CALLS))

    functions = blocks.filter((F.col("code_type") == "function") & F.col("function_name").isNotNull())
    names = bind(_masked(F.col("code"), F.col("language"), languages), called)
    return cut_lineage(functions.select(*scope, F.col("function_name").alias("src"), names.alias("names")))


def _called_names(functions: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """(scope, src, dst): names that a function calls, known or not, each once."""
    return functions.select(*scope, "src", F.explode("names").alias("dst")).distinct()


def class_graph(blocks: DataFrame, scope: tuple[str, ...] = (), known_only: bool = True) -> DataFrame:
    """(src, dst) from a class to its parents; with ``known_only`` parents must be classes of the table."""
    classes = blocks.filter(F.col("code_type") == "class").select(*scope, F.col("class_name").alias("src"), "all_bases")
    if known_only:
        classes = cut_lineage(classes)  # read twice, and the blocks would be cut again
    edges = classes.select(*scope, "src", F.explode("all_bases").alias("dst")).distinct()
    if not known_only:
        return edges
    known = classes.select(*scope, F.col("src").alias("dst")).distinct()
    return edges.join(known, [*scope, "dst"], "left_semi").select(*scope, "src", "dst")


def module_of(path: Column) -> Column:
    """Module name of a file: its path without the suffix, dots for slashes."""
    stem = F.regexp_replace(F.regexp_replace(path, r"\.[^./]*$", ""), r"/__init__$", "")
    return F.replace(stem, F.lit("/"), F.lit("."))


def imported_modules(text: Column, language: Column, languages=DEFAULT_LANGUAGES) -> Column:
    """Module names on the import lines of one text; Python text is masked, so that docstrings do not count."""
    return bind(
        F.struct(text.alias("raw"), _masked(text, language, languages).alias("masked")),
        lambda t: _import_names(t["raw"], t["masked"], language),
    )


def _import_names(text: Column, masked: Column, language: Column) -> Column:
    python_names = F.concat(
        F.flatten(
            F.transform(
                F.regexp_extract_all(masked, F.lit(r"(?m)^[ \t]*import[ \t]+([^\n#;]+)"), F.lit(1)),
                lambda line: F.transform(
                    F.split(line, ","), lambda one: F.regexp_extract(one, r"^\s*([\w.]+)", 1)
                ),
            )
        ),
        F.regexp_extract_all(masked, F.lit(r"(?m)^[ \t]*from[ \t]+([\w.]+)[ \t]+import\b"), F.lit(1)),
    )
    script_names = F.regexp_extract_all(
        text, F.lit(r"""(?m)^[ \t]*(?:import|export)\b[^\n;'"]*['"]([^'"\n]+)['"]"""), F.lit(1)
    )
    php_names = F.concat(
        F.transform(
            F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*use[ \t]+\\?([\w\\]+)"), F.lit(1)),
            lambda n: F.replace(n, F.lit("\\"), F.lit(".")),
        ),
        F.regexp_extract_all(
            text, F.lit(r"""(?m)^[ \t]*(?:require|include)(?:_once)?[ \t(]+['"]([^'"\n]+)['"]"""), F.lit(1)
        ),
    )
    names = (
        F.when(language == "python", python_names)
        .when(language == "typescript", script_names)
        .when(language == "php", php_names)
    )
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def import_graph(
    files: DataFrame, scope: tuple[str, ...] = (), known_only: bool = False, languages=DEFAULT_LANGUAGES
) -> DataFrame:
    """(src, dst) from a module to the modules it imports directly."""
    language = language_of(F.col("filepath"), languages)
    edges = (
        explode_once(
            files.filter(suffix(F.col("filepath")) != ""),
            [*scope, module_of(F.col("filepath")).alias("src")],
            imported_modules(F.col("content"), language, languages),
            "_at",
            "dst",
        )
        .drop("_at")
        .distinct()
    )
    if not known_only:
        return edges
    known = files.select(*scope, module_of(F.col("filepath")).alias("dst")).distinct()
    return edges.join(known, [*scope, "dst"], "left_semi").select(*scope, "src", "dst")


def _stem(path: Column) -> Column:
    """Path without its ending; a file that stands for its folder has the folder's path."""
    own = F.regexp_replace(path, r"(^|/)(__init__\.py|index\.[jt]sx?)$", "")
    return F.when(own != path, own).otherwise(F.regexp_replace(path, r"\.[^./]*$", ""))


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def _wanted_paths(folder: Column, language: Column, name: Column) -> Column:
    """Keys that may name the imported file, best first: ``/stem`` is a whole path, ``stem`` the end of one.

    A relative import names one path. Others are looked for below the folder of the importing file, then below each
    folder above it, and if they have two parts or more, at the end of any path.
    """
    folders = F.filter(F.split(folder, "/"), lambda f: f != "")
    dots = F.length(F.regexp_extract(name, r"^(\.*)", 1))
    python_relative = (language == "python") & (dots > 0)
    # each dot after the first leads one folder up
    above = F.transform(F.sequence(F.lit(1), F.greatest(dots, F.lit(1))), lambda n: F.when(n == 1, ".").otherwise(".."))
    as_path = F.regexp_replace(name, r"\.(php|inc|ts|tsx|js|jsx|mjs)$", "")
    is_path = (language == "typescript") | ((language == "php") & (as_path != name))
    parts = F.when(is_path, F.split(as_path, "/")).otherwise(F.split(F.ltrim(name, F.lit(".")), r"\."))
    parts = F.when(python_relative, F.concat(above, parts)).otherwise(parts)
    parts = F.filter(parts, lambda x: x != "")
    relative = python_relative | (is_path & name.startswith("."))

    def walked(steps: Column) -> Column:
        return F.aggregate(
            steps,
            folders,
            lambda at, step: F.when(step == ".", at)
            .when(step == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))))
            .otherwise(F.concat(at, F.array(step))),
        )

    def found_below(steps: Column) -> Column:
        roots = F.transform(F.sequence(F.size(folders), F.lit(0), F.lit(-1)), lambda n: F.slice(folders, 1, n))
        return F.transform(roots, lambda root: F.concat(F.lit("/"), F.array_join(F.concat(root, steps), "/")))

    def keys(steps: Column) -> Column:
        anywhere = F.when(F.size(steps) > 1, F.array(F.array_join(steps, "/"))).otherwise(F.array().cast("array<string>"))
        one = F.array(F.concat(F.lit("/"), F.array_join(walked(steps), "/")))
        return F.when(relative, one).otherwise(F.concat(found_below(steps), anywhere))

    return bind(parts, keys)


def resolved_imports(files: DataFrame, scope: tuple[str, ...] = (), languages=DEFAULT_LANGUAGES) -> DataFrame:
    """G16 down to files: (filepath, module, target) for every import that names another file of the table.

    A name is resolved once for each folder that uses it. Every path is known under its whole stem and under the ends
    of it; of the files with one end the one with the fewest folders, then the least path, is meant, so no key of the
    join has two files. Names found nowhere (libraries) give no row. Both sides of each join grow with the files, and the
    engine estimates them far too small, so joins are by shuffle: a broadcast would pass the driver.
    """
    listed = files.filter(F.col("filepath").isNotNull()).withColumn("language", language_of(F.col("filepath"), languages))
    modules = imported_modules(F.col("content"), F.col("language"), languages)
    imports = cut_lineage(  # read twice, and the texts would be masked again
        explode_once(listed, [*scope, "filepath", "language"], modules, "_at", "module")
        .drop("_at")
        .distinct()
        .withColumn("folder", _folder(F.col("filepath")))
    )
    stem = F.split(_stem(F.col("filepath")), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(stem)), lambda n: F.array_join(F.slice(stem, n, F.size(stem)), "/"))
    known = (
        listed.select(
            *scope,
            "language",
            F.struct(F.size(stem).alias("depth"), F.col("filepath").alias("target")).alias("file"),
            F.explode(F.concat(F.array(F.concat(F.lit("/"), _stem(F.col("filepath")))), ends)).alias("key"),
        )
        .groupBy(*scope, "language", "key")
        .agg(F.min("file")["target"].alias("target"))
        .hint("merge")
    )
    asked = [*scope, "language", "folder", "module"]
    keys = _wanted_paths(F.col("folder"), F.col("language"), F.col("module"))
    wanted = imports.select(*asked).distinct().select(*asked, F.posexplode(keys).alias("nearness", "key"))
    best = (
        wanted.join(known, [*scope, "language", "key"])
        .groupBy(*asked)
        .agg(F.min(F.struct("nearness", "target"))["target"].alias("target"))
        .hint("merge")
    )
    return imports.join(best, asked).filter(F.col("filepath") != F.col("target")).select(
        *scope, "filepath", "module", "target"
    )


def resolved_calls(
    blocks: DataFrame, imports: DataFrame, scope: tuple[str, ...] = (), languages=DEFAULT_LANGUAGES
) -> DataFrame:
    """G14 down to files: (filepath, src, target, dst) from a function to the functions that its calls can mean.

    ``imports`` are rows of ``resolved_imports``. A name means the function of the same file if there is one, else that
    of every directly imported file that has one; other names give no row, so equal names of two files stay apart. Joins
    are by shuffle, as in ``resolved_imports``.
    """
    functions = _functions(blocks, (*scope, "filepath"), languages)
    calls = _called_names(functions, (*scope, "filepath"))
    known = functions.select(*scope, F.col("filepath").alias("target"), F.col("src").alias("dst")).distinct().hint("merge")
    here = known.select(*scope, F.col("target").alias("filepath"), "dst")
    own = [*scope, "filepath", "dst"]
    near = calls.join(here, own, "left_semi").withColumn("target", F.col("filepath"))
    far = (
        calls.join(here, own, "left_anti")
        .join(imports.select(*scope, "filepath", "target").distinct().hint("merge"), [*scope, "filepath"])
        .join(known, [*scope, "target", "dst"], "left_semi")
    )
    columns = [*scope, "filepath", "src", "target", "dst"]
    return near.select(*columns).unionByName(far.select(*columns))
