"""Divergence of sources against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from corpusloom.llm import divergence
from corpusloom.llm.divergence import source_divergence

random.seed(5)
VOCABULARY = ["alpha", "Beta", "GAMMA", "délta", "Éps", "éps", "zeta", "日本", "k", "rare"]


def _text(lean):
    return " ".join(random.choices(VOCABULARY, [1 + 3 * (k % 4 == lean) for k in range(9)] + [0.02], k=30)) + "-x1y_z"


DOCS = [(n, _text(n % 4), ["en", "fr"][n % 2], f"s{n % 5}", "t") for n in range(120)] + [
    (None, None, "en", "s1", "t"), (7, "", "en", "empty", "t"), (8, "12 34 __", "de", "s1", "t"), (9, None, "de", "s2", "t"),
    (10, "alpha " * 300_000 + "beta", None, None, "t"), (11, "beta", None, "", "t"), (12, "alone", "one", "only", "t"),
    (12, "alone", "one", "only", "t"), (13, "A" * 200_000, "en", "s1", "t"),
]
SCHEMA = "doc_id long, text string, lang string, source string, part string"


def brute(docs, least, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, within, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        counts[lang or "", source or ""].update(terms)
        within[lang or ""].update(set(terms))
        groups[lang or ""].add(source or "")
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in within[lang].items() if n >= least]
        tables = {s: counts[lang, s] for s in sources}
        share = {}
        for name, table in [*tables.items(), (None, sum(tables.values(), Counter()))]:
            total = sum(table[t] for t in kept)
            share[name] = {t: 1 + 10**9 * (table[t] + 2) // (total + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(o, sum(f(share[s][t], share[o][t]) for t in kept)) for o in sources if o != s]
            terms = [
                (t, f(share[s][t], share[None][t])) for t in kept if tables[s][t] > 0 and share[s][t] > share[None][t]
            ]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [
                    (lang, s, part, item, value, r)
                    for r, (item, value) in enumerate(found, 1)
                    if part == "pair" or r <= top
                ]
    return sorted(out)


def result(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("digest_bits", [64, 2])
def test_odd(spark, digest_bits):
    """With digests of two bits nearly all terms collide and are told apart by their texts."""
    docs = spark.createDataFrame(DOCS, SCHEMA).repartition(3)
    got = result(source_divergence(docs, 10, 4, digest_bits))
    assert got == brute(DOCS, 10, 4)
    assert {r[0] for r in got if r[2] == "term"} == {"en", "fr"}
    assert sum(r[0] == "de" and r[4] == 0 for r in got) == 2


def test_every_term_kept_and_empty(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    assert result(source_divergence(docs, 1, 10, 5)) == brute(DOCS, 1, 10)
    assert source_divergence(docs.where("lang = 'xx'")).collect() == []


def test_large_counts(spark):
    """Counts that would overflow 64 bits when scaled stay exact."""
    big = 9_000_000_000_000
    row = spark.range(1).select(divergence.share(*[divergence.F.lit(x) for x in (big, big + 5, 3)]).alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 2) // (big + 5 + 6)


def test_slices_cut_no_term(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 7)
    for text in ("", "abc", "abcdefghijklmnop q", "a b c d e f g h i jklmnopqrstuvw xyz" * 3, "é" * 30 + " x"):
        data = text.encode()
        found = [t for piece in divergence.slices(data) for t in divergence.TERM.findall(piece)]
        assert found == divergence.TERM.findall(data)
        assert b"".join(divergence.slices(data)) == data


def test_parts(monkeypatch):
    """Texts counted in one part, in many, and as long ones, give the same sums."""
    texts = ["a B a", "", "ab", "É c", "c" * 40 + " a a", None, "x-1", "a"]
    batch = divergence.pa.record_batch(
        [divergence.pa.array(x) for x in (["l"] * 8, ["s", "t"] * 4, [t or "" for t in texts])], names=["lang", "source", "text"]
    )
    sums = []
    for part in (1 << 20, 3, 8):
        monkeypatch.setattr(divergence, "PART", part)
        total = Counter()
        for rows, group, terms, term, tf, df in divergence._occurrences([batch], ["lang", "source"]):
            for g, t, *n in zip(group, term, tf, df):
                for kind, x in zip(("tf", "df"), n):
                    total[rows.column("source")[int(g)].as_py(), terms[int(t)].as_py(), kind] += int(x)
        sums.append(total)
    assert sums[0] == sums[1] == sums[2]
    assert sums[0]["s", b"a", "tf"] == 4 and sums[0]["s", b"a", "df"] == 2 and sums[0]["t", "É".encode(), "tf"] == 1


def test_digests_only_are_counted(spark):
    """Sums of occurrences are exchanged by digest; no text of a term is in them."""
    counts = spark.createDataFrame([(0, 1, "", "t", 1, 1, "en")], "no int, digest long, split string, term string, tf long, df long, lang string")
    plan = divergence._by_lang(counts, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") >= 2 and "min(term" not in plan and "term#" not in "".join(re.findall(r"Exchange [^\n]*", plan))


def test_a_term_is_spelled_once_in_a_part():
    """Its other rows have the digest alone; when digests clash, every row has the text."""
    import numpy as np
    import pyarrow as pa
    from types import SimpleNamespace

    every = SimpleNamespace(value=np.full(1 << (divergence.FILTER_BITS - 6), -1, np.int64).view(np.uint64))
    batch = pa.record_batch([["l"] * 3, ["a", "b", "c"], ["x y", "y Z", "z x"]], names=["lang", "source", "text"])
    for spelled, texts in ((False, 3), (True, 6)):
        rows = [r for b in divergence._counted(every, 64, spelled)([batch]) for r in b.to_pylist()]
        assert len(rows) == 6 and sum(r["term"] is not None for r in rows) == texts
        assert len({r["digest"] for r in rows}) == 3 and {r["term"] for r in rows} - {None} == {"x", "y", "z"}
