"""Toxicity by weak supervision: many voters, a generative model of their votes, and a linear classifier.

Voters are words and beginnings of words: a small general lexicon, and patterns mined from labelled texts. A voter speaks
up in a text if one of its words is there at all or, as another voter, if at least one word in DENSE is, so that a chance
find in a long text need not say much. A generative label model estimates how accurate each voter is and which voters only repeat each other, and from that the probability
that each labelled text is toxic. A logistic regression on presence and share of such words learns these probabilities; it alone scores.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.registry import query, small_batches, table, texts
from corpusloom.session import scratch_path

#: A general lexicon of insults (own choice); every word is a voter.
LEXICON = (
    "idiot moron stupid trash scum loser clown pathetic worthless disgusting dumb imbecile filth vermin jerk "
    "bastard garbage fool crap hate"
).split()
#: Labelled texts the model is fitted on, at most; those whose ids have the least hashes.
LABELLED = 20_000
#: Features of the classifier, and mined voters of either sign, at most.
FEATURES, VOTERS = 600, 64
BEGINNINGS = (3, 4, 5, 6, 7)
#: One word in so many makes a stem dense; a share of FULL has the whole weight of the feature.
DENSE, FULL = 100, 0.015
WORD = r"[^\W\d_]+"


def stems(word: str) -> list[str]:
    """The word itself and its beginnings, marked as such."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


@dataclass
class Model:
    features: list[str]
    weights: np.ndarray
    constant: float
    #: What the label model found: (voter, its sign, accuracy on posterior labels, weight after correlations).
    voters: list[tuple[str, int, float, float]]


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of each text to be toxic, accuracies, weights of the voters), by expectation maximisation.

    ``votes`` (texts x voters) holds 1 for toxic, -1 for clean, 0 for no opinion; ``given`` are the human labels 0 and 1,
    which count as one more voter that is right nineteen times in twenty. Voters that agree with each other beyond what
    the estimated label explains are correlated; such a voter's evidence is divided by one plus the correlations it has.
    """
    speaks = votes != 0
    own = np.where(given > 0, np.log(19.0), -np.log(19.0))
    chance = 1 / (1 + np.exp(-(own + votes.sum(axis=1))))
    weights, accuracy = np.ones(votes.shape[1]), np.full(votes.shape[1], 0.7)
    for _ in range(rounds):
        prior = np.clip(chance.mean(), 1e-3, 1 - 1e-3)
        toxic, clean = chance[:, None], 1 - chance[:, None]
        # How often a voter speaks up in toxic and in clean texts, and how often it is right when it speaks.
        in_toxic = ((speaks * toxic).sum(0) + prior) / (toxic.sum() + 2 * prior)
        in_clean = ((speaks * clean).sum(0) + prior) / (clean.sum() + 2 * prior)
        right = (votes > 0) * toxic + (votes < 0) * clean
        accuracy = (right.sum(0) + 1) / (speaks.sum(0) + 2)
        expected = toxic * in_toxic + clean * in_clean
        rest = speaks - expected
        scale = np.sqrt((rest * rest).mean(0)) + 1e-9
        correlation = (rest / scale).T @ (rest / scale) / len(votes)
        np.fill_diagonal(correlation, 0)
        weights = 1 / (1 + np.where(correlation > 0.1, correlation, 0).sum(1))
        evidence = np.where(
            speaks, np.log(in_toxic / in_clean), np.log((1 - in_toxic) / (1 - in_clean))
        )
        log_odds = np.log(prior / (1 - prior)) + own + (evidence * weights).sum(1)
        new = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        done, chance = np.abs(new - chance).max() < 1e-4, new
        if done:
            break
    return chance, accuracy, weights


def logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Weights and constant of a ridge logistic regression on probabilities ``y``, by Newton steps."""
    rows = np.column_stack([x, np.ones(len(x), x.dtype)])
    w = np.zeros(rows.shape[1])
    ridge = np.full(rows.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (y - p) - ridge * w
        step = np.linalg.solve((rows * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ rows + np.diag(ridge), slope)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def fit(
    docs: DataFrame, labelled: DataFrame, most: int = LABELLED, doc_id: str = "doc_id", text: str = "text",
    label: str = "label", penalty: float = 0.3,
) -> Model:
    """Learns from the documents of ``docs`` whose id has a label (1 toxic, 0 not) in ``labelled``.

    At most ``most`` labelled ids are used, those with the least hashes; null ids and labels are left out, and of an id
    labelled twice the greater label holds. Without labelled documents the model scores all texts alike, about 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen = (
        labelled.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    path = scratch_path(spark, "labelled-texts")
    # Bounded by ``most`` rows of two numbers, so it may be broadcast whatever the size of the labels.
    texts(docs, doc_id, text).join(F.broadcast(chosen), "doc_id").select("text", "label").write.parquet(path)
    sample = spark.read.parquet(path)

    def seen(batches):
        import regex

        find = regex.compile(WORD)
        for batch in batches:
            counts: dict = {}
            for value, toxic in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = Counter(find.findall(value.lower()))
                shares: Counter = Counter()
                for word, times in words.items():
                    for stem in stems(word):
                        shares[stem] += times
                least = sum(words.values()) / DENSE
                for stem, times in shares.items():
                    counts.setdefault(stem, [0, 0])[1 if toxic else 0] += 1
                    if times >= least:
                        counts.setdefault(stem + "%", [0, 0])[1 if toxic else 0] += 1
            yield pa.record_batch(
                [pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))],
                names=["stem", "clean", "toxic"],
            )

    totals = {r.label > 0: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = totals.get(True, 0), totals.get(False, 0)
    if not n_toxic + n_clean:
        return Model([], np.zeros(0), -4.0, [])
    # Likelihood ratio of the stem's presence in toxic and clean texts, signed by the side where it is more frequent.
    t, c = F.col("toxic"), F.col("clean")
    n, share = F.lit(float(n_toxic + n_clean)), (F.col("toxic") + F.col("clean")) / F.lit(float(n_toxic + n_clean))

    def part(observed, expected):
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    gain = 2 * (
        part(t, share * n_toxic) + part(c, share * n_clean)
        + part(F.lit(n_toxic) - t, (1 - share) * n_toxic) + part(F.lit(n_clean) - c, (1 - share) * n_clean)
    )
    mined = (
        sample.mapInArrow(seen, "stem string, clean long, toxic long")
        .groupBy("stem")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where((t + c >= 3) & (n > t + c))
        .withColumn("gain", gain)
        .withColumn("sign", F.when(t * n_clean > c * n_toxic, 1).otherwise(-1))
        .orderBy(F.desc("gain"), "stem")
        .limit(FEATURES)
        .collect()
    )
    features = [r.stem for r in mined if r.gain > 8]
    features += [w for w in LEXICON if w not in features]
    signs = {r.stem: r.sign for r in mined}
    x, y = _matrix(sample, features)
    voters = [k for sign in (1, -1) for k in [k for k, s in enumerate(features) if signs.get(s, 1) == sign][:VOTERS]]
    voters += [k for k, s in enumerate(features) if s in LEXICON and k not in voters]
    direction = np.array([signs.get(features[k], 1) for k in voters])
    least = np.array([1 / DENSE / FULL if features[k][-1] == "%" else 1e-9 for k in voters])
    chance, accuracy, weights = label_model((x[:, voters] >= least) * direction, y)
    learned, constant = logistic(x, chance, penalty)
    found = [(features[k], int(s), float(a), float(w)) for k, s, a, w in zip(voters, direction, accuracy, weights)]
    return Model(features, learned, constant, found)


def _shares(features: list[str]):
    """A function from a text to {feature: its value}: 1 for a stem that is there, and for a dense one (marked %) the
    share of its words over FULL, 1 at most. Words that recur in a task are looked up once."""
    import regex

    find, number, held = regex.compile(WORD), {s: k for k, s in enumerate(features)}, {}
    dense = [s[-1] == "%" for s in features]

    def of(text: str) -> dict[int, float]:
        words, times = find.findall(text.lower()), {}
        for word in words:
            known = held.get(word)
            if known is None:
                if len(held) > 300_000:
                    held.clear()
                known = held[word] = tuple(
                    number[s] for stem in stems(word) for s in (stem, stem + "%") if s in number
                )
            for k in known:
                times[k] = times.get(k, 0) + 1
        return {k: min(1.0, times[k] / (FULL * len(words))) if dense[k] else 1.0 for k in sorted(times)}

    return of


def _matrix(sample: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(values of features, labels) of the labelled texts, bounded by the sample's rows."""

    def run(batches):
        shares = _shares(features)
        for batch in batches:
            found = [shares(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [
                    batch.column("label"),
                    pa.array([list(f) for f in found], pa.list_(pa.int32())),
                    pa.array([list(f.values()) for f in found], pa.list_(pa.float64())),
                ],
                names=["label", "features", "shares"],
            )

    rows = sample.mapInArrow(run, "label int, features array<int>, shares array<double>").toPandas()
    x = np.zeros((len(rows), len(features)))
    for k, (which, shares) in enumerate(zip(rows["features"], rows["shares"], strict=True)):
        x[k, which] = shares
    return x, (rows["label"].to_numpy() > 0).astype(float)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row: the model's probability that the whole text is toxic.

    Null and empty texts are scored like any text without features. Null and repeated ids give a row each, an empty table
    none. No shuffle; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        shares, weights = _shares(model.features), model.weights.tolist()
        for batch in batches:
            sums = [
                model.constant + sum(weights[k] * v for k, v in shares(t).items())
                for t in batch.column("text").to_pylist()
            ]
            scores = 1 / (1 + np.exp(-np.clip(np.array(sums, float), -30, 30)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return texts(docs, doc_id, text).mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores below ``threshold``."""
    small_batches(docs.sparkSession)

    def run(batches):
        shares, weights = _shares(model.features), model.weights.tolist()
        least = np.log(threshold / (1 - threshold))
        for batch in batches:
            sums = [
                model.constant + sum(weights[k] * v for k, v in shares(t or "").items())
                for t in batch.column(text).to_pylist()
            ]
            yield batch.filter(pa.array([s < least for s in sums], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


def learning_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the labels that may be learned from: the checksum of the id, modulo 4, is not 2."""
    return labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))


@query()
def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, learning_labels(table(spark, sf_dir, "labels")))
    return score(docs, model).select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
