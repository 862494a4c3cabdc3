"""How the words of a source differ from those of other sources and of its whole language.

A first pass sums digests of terms alone and leaves a filter of fixed size, so rare terms don't leave their task in the
second. That one writes counts by 64-bit digests, which are summed without the terms' texts. The least and the greatest text
of a digest are compared: where they differ, the texts are counted again, and the digest is split. Texts come back only for the rows of the result.
All arithmetic is exact.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.rows import join_few
from corpusloom.llm.registry import query, table
from corpusloom.llm.words import buffer_of, digests
from corpusloom.session import scratch_path

#: In UTF-8 these bytes are a longest run of ASCII letters and of characters from U+0080 on.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes of terms in lower case; 0 for all others.
_LETTERS = np.array([c if TERM.match(bytes([c])) else 0 for c in bytes(range(256)).translate(TO_LOWER)], np.uint8)
#: Bytes of texts that a task counts at a time, and of slices of a longer text.
PART, SLICE = 16 << 20, 1 << 20
#: Bits of the filter of terms that may be kept: 8 MB.
FILTER_BITS = 26
#: Cells of the matrix of terms and sources that a task works on at a time.
CELLS = 1 << 20
#: Probabilities are whole numbers of a billionth, and every term counts two more than it occurs.
SCALE, EXTRA = 1_000_000_000, 2

COUNTS = "lang string, source string, digest long, term string, tf long, df long"


def slices(text: bytes):
    """The text in pieces of about SLICE bytes that cut no term."""
    at = 0
    while at < len(text):
        upto = at + SLICE
        if upto < len(text):
            rest = TERM.match(text, upto)  # a term that goes on behind the cut stays whole
            upto = rest.end() if rest else upto
        yield text[at:upto]
        at = upto


def _terms_of(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of some texts in order, and the numbers of their texts."""
    data, offsets = buffer_of(column)
    letters = _LETTERS[data]
    inside = letters > 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = np.diff(offsets) > 0
    begins[offsets[:-1][filled]] = inside[offsets[:-1][filled]]
    ends[offsets[1:][filled] - 1] = inside[offsets[1:][filled] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    edges = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(edges), pa.py_buffer(letters[inside])])
    return terms.dictionary_encode(), np.searchsorted(offsets, start, "right") - 1


def _long_text(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """The distinct terms of a text and their occurrences, from slices of it."""
    occurs: Counter = Counter()
    for piece in slices(text):
        occurs.update(TERM.findall(piece.translate(TO_LOWER)))
    return pa.array(list(occurs), pa.binary()), np.array(list(occurs.values()), np.int64)


def _occurrences(batches, by: list[str]):
    """(groups, group, terms, term, tf, df): for each part of the texts, what each group of the columns ``by`` has of each
    term; ``group`` and ``term`` are places in ``groups`` and ``terms``."""
    for batch in batches:
        sizes = np.diff(buffer_of(batch.column("text"))[1])
        part = np.cumsum(sizes) // PART
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1) != 0)
        for a, b in zip(cuts[:-1], cuts[1:]):
            rows = pa.table({c: batch.column(c).slice(a, b - a) for c in by}).group_by(by, use_threads=False).aggregate([])
            place = {tuple(r.values()): n for n, r in enumerate(rows.to_pylist())}
            group = np.array([place[r] for r in zip(*(batch.column(c).slice(a, b - a).to_pylist() for c in by))], np.int64)
            if b - a == 1 and sizes[a] > PART:
                terms, tf = _long_text(batch.column("text")[int(a)].as_buffer().to_pybytes())
                yield rows, np.zeros(len(terms), np.int64), terms, np.arange(len(terms)), tf, np.ones(len(terms), np.int64)
                continue
            coded, text = _terms_of(batch.column("text").slice(a, b - a))
            terms, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            n = max(1, len(terms))
            found, tf = np.unique(group[text] * n + code, return_counts=True)
            once = np.sort(text * n + code)
            once = once[np.diff(once, prepend=-1) != 0]  # a term counts once for each text
            _, df = np.unique(group[once // n] * n + once % n, return_counts=True)
            yield rows, found // n, terms, found % n, tf, df


def _digests(terms: pa.Array) -> np.ndarray:
    data, offsets = buffer_of(terms)
    return digests(data, offsets[:-1], offsets[1:])[0]


def _documents_of_terms(batches):
    """(key, df): in how many documents of a part the terms of a language are, by a digest of both."""
    for rows, group, terms, term, _, df in _occurrences(batches, ["lang"]):
        keys = _digests(terms)[term] ^ _salts(rows)[group]
        yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(df, pa.int64())], names=["key", "df"])


def _salts(rows: pa.Table) -> np.ndarray:
    """A digest of each group's language."""
    return np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in rows.column("lang").to_pylist()], np.uint64)


def _frequent(rows: DataFrame, least: int) -> np.ndarray:
    """Bits of the keys in at least ``least`` documents, at their lowest FILTER_BITS bits.

    What has its bit set may be kept; what has not is not, and need not leave its task. At most 2**FILTER_BITS bits come to
    the driver, by words of 64.
    """
    keys = rows.select("lang", "text").mapInArrow(_documents_of_terms, "key long, df long")
    bit = F.col("key").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = (
        keys.groupBy("key")
        .agg(F.sum("df").alias("df"))
        .where(F.col("df") >= least)
        .groupBy(F.shiftright(bit, 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
        .toArrow()
    )
    found = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    found[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return found.view(np.uint64)


def _counted(frequent, digest_bits: int, spelled: bool):
    """Terms with their occurrences and documents in a part, by lang and source; unless ``spelled``, the text of a term is
    only in the first of its rows."""

    def count(batches):
        for rows, group, terms, term, tf, df in _occurrences(batches, ["lang", "source"]):
            whole = _digests(terms)
            keys = (whole[term] ^ _salts(rows)[group]) & np.uint64((1 << FILTER_BITS) - 1)
            may = np.flatnonzero(frequent.value[keys >> np.uint64(6)] >> (keys & np.uint64(63)) & np.uint64(1))
            short = whole >> np.uint64(64 - digest_bits)
            again = np.full(len(may), not spelled)
            again[np.unique(term[may], return_index=True)[1]] = False
            yield pa.record_batch(
                [
                    *(rows.column(c).combine_chunks().take(pa.array(group[may])) for c in ("lang", "source")),
                    pa.array(short[term[may]].view(np.int64)),
                    terms.take(pa.array(term[may], mask=again)).cast(pa.string()),
                    pa.array(tf[may], pa.int64()),
                    pa.array(df[may], pa.int64()),
                ],
                names=[c.split()[0] for c in COUNTS.split(", ")],
            )

    return count


def _by_lang(counts: DataFrame, least: int) -> DataFrame:
    """(lang, digest, split, total, held): terms in at least ``least`` documents of a language; ``held`` has (no, tf) of its
    groups. A hot group is summed within tasks before the shuffle."""
    keys = ["lang", "digest", "split"]
    return (
        counts.groupBy(*keys, "no")
        .agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
        .groupBy(*keys)
        .agg(F.sum("tf").alias("total"), F.sum("df").alias("df"), F.collect_list(F.struct("no", "tf")).alias("held"))
        .where(F.col("df") >= least)
        .drop("df")
    )


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    above = F.lit(SCALE).cast("decimal(10,0)") * wide(count + F.lit(EXTRA))
    return F.lit(1) + F.call_function("div", above, wide(total + F.lit(EXTRA) * kept))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_sums(batches):
    """(lang, a, b, value) with a < b: sums over terms of the distance between two groups' shares."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            rows = np.flatnonzero(langs.indices.to_numpy() == code)
            base = batch.column("none")[int(rows[0])].values.to_numpy()
            sums = held.setdefault(lang, np.zeros((len(base), len(base)), np.int64))
            step = max(1, CELLS // len(base))
            for at in range(0, len(rows), step):
                _add_distances(sums, base, batch.column("shares").take(pa.array(rows[at : at + step])))
    for lang, sums in held.items():
        for a in range(len(sums) - 1):
            n = len(sums) - a - 1
            yield pa.record_batch(
                [
                    pa.repeat(lang, n),
                    pa.repeat(pa.scalar(a, pa.int32()), n),
                    pa.array(np.arange(a + 1, len(sums)), pa.int32()),
                    pa.array(sums[a, a + 1 :]),
                ],
                names=["lang", "a", "b", "value"],
            )


def _add_distances(sums: np.ndarray, base: np.ndarray, shares: pa.ListArray) -> None:
    lengths = np.diff(shares.offsets.to_numpy())
    flat = shares.flatten()
    p = np.tile(base, (len(shares), 1))
    p[np.repeat(np.arange(len(shares)), lengths), flat.field("no").to_numpy()] = flat.field("p").to_numpy()
    for a in range(len(base) - 1):
        own, other = p[:, a : a + 1], p[:, a + 1 :]
        sums[a, a + 1 :] += ((own - other) ** 2 // (own + other)).sum(axis=0)


def source_divergence(
    docs: DataFrame, least: int = 10, top: int = 10, digest_bits: int = 64, lang: str = "lang", source: str = "source",
    text: str = "text",
) -> DataFrame:
    """Rows lang, source, part, item, value, rank for each group, a lang and source that occur together.

    Terms are longest runs of letters A-Z and of characters from U+0080 on, only A-Z in lower case; a language keeps those
    in at least ``least`` of its documents. Each group and each whole language give each kept term a share, see ``share``.
    The distance of two shares p and q is floor((p-q)^2 / (p+q)).

    Part ``pair``: ``item`` is another source of the language, ``value`` the sum of distances over all kept terms (0 if
    there are none). Part ``term``: ``item`` is a kept term that the group has and gives more than its language does,
    ``value`` the distance; ranks to ``top``. Ranks start at 1 in each group and part, by falling value, then by item.

    Null langs, sources and texts are empty ones. Groups whose texts have no terms have their pairs. Ids play no part, so
    repeated rows are documents of their own. An empty table gives no rows. Other columns are ignored.

    Tasks count their own terms first, so a language or source that a third of all rows have costs a row for each of its
    terms and parts of 16 MB of text. A longer text is cut into slices of 1 MB between terms; its distinct terms are held. Pairs take as many steps
    as terms times pairs; a task holds a number for each pair. ``digest_bits`` shortens digests, for tests of splitting.
    """
    spark = docs.sparkSession
    rows = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for name, c in (("lang", lang), ("source", source), ("text", text))]
    )
    where = {name: scratch_path(spark, f"divergence-{name}") for name in ("counts", "groups", "terms", "names", "kept")}

    def kept_at(name: str, frame: DataFrame) -> DataFrame:
        frame.write.parquet(where[name])
        return spark.read.schema(frame.schema).parquet(where[name])

    by_source = Window.partitionBy("lang").orderBy("source")
    numbered = kept_at(
        "groups", rows.select("lang", "source").distinct().withColumn("no", F.row_number().over(by_source) - 1)
    )
    frequent = spark.sparkContext.broadcast(_frequent(rows, least))
    written = kept_at("counts", rows.mapInArrow(_counted(frequent, digest_bits, False), COUNTS))
    counts = join_few(written, numbered, ["lang", "source"]).drop("source")

    whole = kept_at("terms", _by_lang(counts.withColumn("split", F.lit("")), least))
    names = kept_at(
        "names",
        written.where(F.col("term").isNotNull())
        .groupBy("digest")
        .agg(F.min("term").alias("low"), F.max("term").alias("high")),
    )
    clashes = names.where(F.col("low") < F.col("high")).select("digest")
    kept = whole
    if not clashes.isEmpty():  # only then are the texts counted again, with a text in every row
        spelled = rows.mapInArrow(_counted(frequent, digest_bits, True), COUNTS)
        spelled = join_few(join_few(spelled, clashes, ["digest"], "left_semi"), numbered, ["lang", "source"])
        apart = _by_lang(spelled.withColumn("split", F.col("term")), least)
        kept = kept_at("kept", join_few(whole, clashes, ["digest"], "left_anti").unionByName(apart))

    # One row for each language: how many terms it keeps, how often they occur there and in each of its groups.
    within = kept.select("lang", F.explode("held").alias("h")).groupBy("lang", F.col("h.no").alias("no")).agg(
        F.sum("h.tf").alias("n")
    )
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("all"))
    sizes = (
        numbered.join(within, ["lang", "no"], "left")
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("no", F.coalesce("n", F.lit(0)).alias("n")))).alias("groups"))
        .select("lang", F.col("groups.n").alias("sizes"))
        .join(langs, "lang")
    )
    shared = join_few(kept, sizes, ["lang"]).select(
        "lang", "digest", "split",
        F.transform("sizes", lambda n: share(F.lit(0), n, F.col("kept"))).alias("none"),
        F.transform(
            "held",
            lambda h: F.struct(
                h["no"].alias("no"), share(h["tf"], F.element_at("sizes", h["no"] + 1), F.col("kept")).alias("p")
            ),
        ).alias("shares"),
        share(F.col("total"), F.col("all"), F.col("kept")).alias("q"),
    )

    sums = (
        shared.select("lang", "none", "shares")
        .mapInArrow(_pair_sums, "lang string, a int, b int, value long")
        .groupBy("lang", "a", "b")
        .agg(F.sum("value").alias("value"))
    )
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    one = numbered.select("lang", "source", F.col("no").alias("a"))
    two = numbered.select("lang", F.col("source").alias("item"), F.col("no").alias("b"))
    pairs = (
        one.join(two, "lang")
        .where("a <> b")
        .join(both, ["lang", "a", "b"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    )

    group = Window.partitionBy("lang", "no").orderBy(F.desc("value"))
    highest = (
        shared.select("lang", "digest", "split", "q", F.explode("shares").alias("s"))
        .where(F.col("s.p") > F.col("q"))
        .select("lang", "digest", "split", F.col("s.no").alias("no"), distance(F.col("s.p"), F.col("q")).alias("value"))
        .withColumn("place", F.rank().over(group))
        .where(F.col("place") <= top)
    )
    spelled = (
        highest.join(names, "digest")
        .join(numbered, ["lang", "no"])
        .select(
            "lang", "source", F.lit("term").alias("part"),
            F.when(F.col("split") == "", F.col("low")).otherwise(F.col("split")).alias("item"), "value",
        )
    )
    ranked = pairs.unionByName(spelled).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    )
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


SQL = r"""
with d as (
  select row_number() over () as n, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents
), w as (
  select n, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d
), k as (
  select lang, term, count(*) as total from w group by all having count(distinct n) >= 10
), c as (
  select lang, source, term, count(*) as c from w join k using (lang, term) group by all
), g as (select distinct lang, source from d),
v as (select lang, count(*) as v, sum(total)::hugeint as n from k group by lang),
s as (
  select g.lang, g.source, coalesce(sum(c.c), 0)::hugeint as n from g left join c using (lang, source) group by all
), grid as (
  select s.lang, s.source, k.term, coalesce(c.c, 0) as c,
    (1 + (1000000000::hugeint * (coalesce(c.c, 0) + 2)) // (s.n + 2 * v.v))::bigint as p,
    (1 + (1000000000::hugeint * (k.total + 2)) // (v.n + 2 * v.v))::bigint as q
  from s join k using (lang) join v using (lang) left join c using (lang, source, term)
), sums as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::bigint as value
  from grid a join grid b on a.lang = b.lang and a.term = b.term and a.source <> b.source
  group by all
), found as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sums.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
    left join sums on sums.lang = a.lang and sums.source = a.source and sums.item = b.source
  union all
  select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from grid where c > 0 and p > q
), ranked as (
  select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from found
)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10
"""


@query(SQL)
def op12_divergence(spark, sf_dir):
    return source_divergence(table(spark, sf_dir, "documents"))
