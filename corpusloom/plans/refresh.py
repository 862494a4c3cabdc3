"""The refresh of a block index as one job."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import IgnoreRule
from corpusloom.functions.rows import split_few
from corpusloom.functions.text import count_tokens
from corpusloom.operators.extract import extract_blocks, is_balanced
from corpusloom.operators.files import attach_file_keys, prune_dirs, stamp_model
from corpusloom.operators.index import append, detect_changes, drop_deleted, drop_outdated
from corpusloom.operators.languages import DEFAULT_LANGUAGES, language_of
from corpusloom.operators.vectors import embed
from corpusloom.schemas import INDEX
from corpusloom.session import cut_lineage

KEYS = ("repo_id", "filepath")


def index_rows(
    files: DataFrame, model_name: str, model=None, languages=DEFAULT_LANGUAGES, once_per_text: bool = False
) -> DataFrame:
    """Blocks of the files with keys, token counts and vectors, in the form of the index.

    With ``once_per_text`` the blocks are cut from their lineage first, because they are then read twice.
    """
    blocks = extract_blocks(attach_file_keys(files), languages)
    keyed = blocks.withColumn(
        "block_id", F.md5(F.concat_ws("|", "repo_id", "filepath", F.col("ordinal").cast("string")))
    ).withColumn("n_tokens", count_tokens(F.col("code")))
    stamped = stamp_model(keyed, model_name)
    vectors = embed(
        cut_lineage(stamped) if once_per_text else stamped, "code", model, once_per_text=once_per_text
    )
    return vectors.select(*[F.col(f.name).cast(f.dataType) for f in INDEX.fields])


def changed_rows(
    files: DataFrame,
    index: DataFrame,
    model_name: str,
    model=None,
    rules: list[IgnoreRule] = (),
    languages=DEFAULT_LANGUAGES,
    once_per_text: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(new rows of the index, keys of the files whose old rows they replace) for files(repo_id, filepath, content).

    Only (key, checksum) rows meet the index, so file texts are not shuffled to find the changes. The states of all files
    are computed once; the shorter of the lists of files to do and not to do is broadcast to the texts, while it is short.
    So a first build, which does all, moves no text either. A file to do whose brackets or quotes don't close is in error:
    it keeps its old rows and gets no new ones, and being unchanged in the index it is tried again next time. Files
    without repo_id are left out.
    """
    usable = _usable(files, rules, languages)
    current = attach_file_keys(usable).select(*KEYS, "file_checksum")
    todo = F.col("status").isin("new", "changed")
    states = cut_lineage(detect_changes(current, index, KEYS).select(*KEYS, "status", todo.alias("todo")))
    work = split_few(usable.select(*KEYS, "content"), states, list(KEYS), "todo")
    sound = F.coalesce(is_balanced(F.col("content"), language_of(F.col("filepath"), languages), languages), F.lit(True))
    tested = cut_lineage(work.select(*KEYS, sound.alias("sound")))  # each text is tested once
    stale = tested.where("sound").join(states.where(F.col("status") == "changed").select(*KEYS), list(KEYS), "left_semi")
    whole = split_few(work, tested, list(KEYS), "sound")
    return index_rows(whole, model_name, model, languages, once_per_text), stale.select(*KEYS)


def _usable(files: DataFrame, rules, languages) -> DataFrame:
    known = language_of(F.col("filepath"), languages).isNotNull() & F.col("repo_id").isNotNull()
    return prune_dirs(files, rules, "filepath").filter(known)


def refresh_index(
    files: DataFrame,
    index: DataFrame,
    model_name: str,
    model=None,
    rules: list[IgnoreRule] = (),
    remove_deleted: bool = False,
    languages=DEFAULT_LANGUAGES,
    once_per_text: bool = False,
) -> DataFrame:
    """The index after the files(repo_id, filepath, content) were taken in, see ``changed_rows``. With
    ``remove_deleted`` the rows of files that are no longer among them go."""
    fresh, stale = changed_rows(files, index, model_name, model, rules, languages, once_per_text)
    kept = drop_outdated(index, stale, KEYS)
    if remove_deleted:
        kept = drop_deleted(kept, _usable(files, rules, languages), KEYS)
    return append(kept, fresh)
