"""Url verdicts: rules first, then a logistic regression on hashed character n-grams of host and path.

All of it is DataFrame expressions. The labelled table is small by a stated bound; the model is one array of weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.registry import query, table
from corpusloom.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    """What lies between the first :// and the next /, ? or #, A-Z in lower case; empty if there is no ://."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty if there is no ://."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits, null if none does.

    A rule fits its host and all subdomains, if the path begins with the rule's.
    """
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        chosen = F.when(
            fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        ).otherwise(chosen)
    return chosen


def grams(host: Column, path: Column, n: int, buckets: int) -> Column:
    """Distinct buckets of the n-grams of the host and of the path, each with a sign before and behind."""

    def of(text: Column, sign: str) -> Column:
        signs = F.split(F.concat(F.lit(sign), text, F.lit("$")), "")
        shifted = [F.slice(signs, k + 1, F.greatest(F.size(signs) - (n - 1), F.lit(1))) for k in range(n)]
        # A lambda must not name the split text: it would be split again for every sign.
        return F.transform(
            F.arrays_zip(*[x.alias(f"s{k}") for k, x in enumerate(shifted)]),
            lambda z: F.pmod(F.xxhash64(F.lit(sign), z), F.lit(buckets)).cast("int"),
        )

    return F.array_distinct(F.concat(of(host, "^"), of(path, "~")))


def train(
    labelled: DataFrame, n: int = 3, buckets: int = 2048, rounds: int = 30, rate: float = 1.0, decay: float = 1e-3,
    most: int = 2000,
) -> list[float]:
    """Weights by gradient descent, each with a step of its own that shrinks with its past gradients, over (url, label); label 1 is block. The last weight is the constant.

    Of the labelled urls those with the ``most`` least hashes are used (the bound of what one round reads); null labels
    and repeated urls (of which one label is kept, the greater) don't count twice. A round is one aggregation that sums
    the gradient of each bucket; only these sums, at most ``buckets`` + 1, come to the driver. Without rows, all weights
    are 0.
    """
    spark = labelled.sparkSession
    path = scratch_path(spark, "labelled-urls")
    (
        labelled.where(F.col("label").isNotNull())
        .groupBy("url")
        .agg(F.max(F.col("label").cast("double")).alias("label"))
        .orderBy(F.xxhash64("url"), "url")
        .limit(most)
        .select("label", grams(host_of(F.col("url")), path_of(F.col("url")), n, buckets).alias("grams"))
        .coalesce(1)
        .write.parquet(path)
    )
    examples = spark.read.parquet(path)
    total = examples.count()
    weights, past = [0.0] * (buckets + 1), [0.0] * (buckets + 1)
    for _ in range(rounds if total else 0):
        wrong = F.col("label") - chance(F.col("grams"), weights, buckets)
        sums = (
            examples.select("grams", (wrong / F.sqrt(F.size("grams") + F.lit(1.0))).alias("pull"))
            .select(F.explode(F.concat("grams", F.array(F.lit(buckets)))).alias("gram"), "pull")
            .groupBy("gram")
            .agg(F.sum("pull").alias("pull"))
            .collect()
        )
        weights = [w * (1 - decay) for w in weights]
        for row in sums:
            past[row.gram] += row.pull * row.pull
            weights[row.gram] += rate * row.pull / math.sqrt(past[row.gram] + 1e-9)
    return weights


def chance(grams_: Column, weights: list[float], buckets: int) -> Column:
    """Probability of block under the weights, a constant array in the plan."""
    held = F.split(F.lit(" ".join(map(repr, weights))), " ").cast("array<double>")  # folded to one literal
    total = F.aggregate(
        grams_, F.element_at(held, buckets + 1), lambda sum_, gram: sum_ + F.element_at(held, gram + 1)
    )
    scale = F.sqrt(F.size(grams_) + F.lit(1.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total / scale))


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    labelled: DataFrame,
    n: int = 3,
    buckets: int = 2048,
    page_id: str = "page_id",
    url: str = "url",
    **training,
) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict (allow or block), score.

    ``rules`` are (verdict, host, path); the longest that fits decides. Where none fits, ``score``, the model's chance of
    block, decides: block above 0.5. ``labelled`` has url and label (1 block, 0 allow). A null url, or one without ://,
    has an empty host and path, fits no rule, and is scored like others. Without labelled rows every score is 0.5, so
    such rows are allowed. Repeated rows and null ids give a row each, an empty table none; other columns are ignored.
    """
    weights = train(labelled.select("url", "label"), n, buckets, **training)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"))
    parts = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = parts.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules)).withColumn(
        "score", chance(grams(F.col("host"), F.col("path"), n, buckets), weights, buckets)
    )
    own = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "score"
    )


#: The rules of the registered query.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query()
def op10_urls(spark, sf_dir):
    """The labelled table holds urls of the pages that rules decide, with their verdicts; the model speaks for the rest."""
    pages = table(spark, sf_dir, "pages")
    fit = rule_for(host_of(F.col("url")), path_of(F.col("url")), RULES)
    labelled = pages.select("url", (fit.verdict == "block").cast("int").alias("label"))
    return judge_urls(pages, RULES, labelled)
