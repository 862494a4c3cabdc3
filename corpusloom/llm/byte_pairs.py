"""Byte-pair encoding of many words at once in numpy matrices, and decoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.registry import query, small_batches, table, texts
from corpusloom.llm.vocabularies import built, parse_ranks, read_vocabulary

NONE = np.int64(1 << 40)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Rank of the token that two adjacent tokens make: an open hash table, looked up for whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [
            (a << 32 | b, rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None
        ]
        bits = max(8, int(4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int64)
        keys, values = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else [np.empty(0, np.int64)] * 2
        slots = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slots] == -1)
            taken, where = np.unique(slots[free], return_index=True)
            put = free[where]
            self.keys[taken], self.ranks[taken] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & self.mask

    def _slots(self, keys):
        return ((keys.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where they make no token; negative ids stand for padding."""
        keys = (left << 32 | right).ravel()
        keys[(left < 0).ravel() | (right < 0).ravel()] = -2
        found = np.full(len(keys), NONE, np.int64)
        at, slots = np.arange(len(keys)), self._slots(keys)
        while len(at):
            held = self.keys[slots]
            hit = held == keys[at]
            found[at[hit]] = self.ranks[slots[hit]]
            on = ~hit & (held != -1)
            at, slots = at[on], (slots[on] + 1) & self.mask
        return found.reshape(left.shape)


class MatrixEncoder:
    """ids of words: rows of equal-length buckets, one merge a row and round."""

    LONG = 512

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = PairTable(ranks)
        self.tokens = {i: t for t, i in ranks.items()}

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        buckets = np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64)
        for bucket in np.unique(buckets):
            at = np.flatnonzero(buckets == bucket)
            width = 1 << int(bucket)
            if width > self.LONG:
                for i in at:
                    out[i] = self._long(words[i])
                continue
            step = max(1, (1 << 21) // width)
            for k in range(0, len(at), step):
                self._bucket(words, at[k : k + step], lengths, width, out)
        return out

    def _bucket(self, words, at, lengths, width, out) -> None:
        sizes = lengths[at].copy()
        padded = b"".join(words[i].ljust(width, b"\0") for i in at)
        ids = self.bytes[np.frombuffer(padded, np.uint8)].reshape(len(at), width)
        ids[np.arange(width) >= sizes[:, None]] = -1
        ranks = np.full((len(at), width), NONE, np.int64)  # at [j]: of the pair j, j + 1; the last column stays NONE
        ranks[:, :-1] = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while len(at):
            where = ranks.argmin(axis=1)  # the leftmost of the lowest
            rows = np.arange(len(at))
            lowest = ranks[rows, where]
            done = lowest == NONE
            if done.any():
                for i, n, row in zip(at[done], sizes[done], ids[done].astype("<u4"), strict=True):
                    out[i] = row[:n].tobytes()
                go = ~done
                at, sizes, ids, ranks, where, lowest = at[go], sizes[go], ids[go], ranks[go], where[go], lowest[go]
                if not len(at):
                    return
                width = int(sizes.max())
                ids, ranks = ids[:, :width], ranks[:, :width].copy()
                ranks[:, -1] = NONE
                rows = np.arange(len(at))
            ids[rows, where] = lowest
            width -= 1
            columns = np.arange(width)
            source = columns + (columns > where[:, None])  # close the gap at where + 1
            ids = np.take_along_axis(ids, source, axis=1)
            ranks = np.take_along_axis(ranks, source, axis=1)
            sizes = sizes - 1
            if sizes.max() < width:
                ids = np.hstack([ids[:, : int(sizes.max())]])
                width = ids.shape[1]
                ranks = ranks[:, :width].copy()
            left, right = np.maximum(where - 1, 0), np.minimum(where + 1, width - 1)
            before = self.pairs.find(ids[rows, left], ids[rows, where])
            after = self.pairs.find(ids[rows, where], ids[rows, right])
            has_left, has_right = where > 0, where + 1 < sizes
            ranks[rows[has_left], left[has_left]] = before[has_left]
            ranks[rows, where] = np.where(has_right, after, NONE)
            ranks[:, -1] = NONE

    def _long(self, word: bytes) -> bytes:
        """One long word: the leftmost lowest pair merges, and with it those of its repeats that would be next anyway.

        A repeat is next unless a merge before it has made a pair of no higher rank; so the merges of a round end with
        the first that makes such a pair.
        """
        ids = self.bytes[np.frombuffer(word, np.uint8)]
        ranks = self.pairs.find(ids[:-1], ids[1:])
        while len(ranks) and (lowest := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == lowest)
            begins = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # of overlapping repeats every other one merges
            within = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
            at = at[within % 2 == 0]
            made = np.full(len(at), lowest)
            edged = np.concatenate([[-1], ids, [-1, -1]])
            before = np.where(np.diff(at, prepend=-9) == 2, lowest, edged[at])
            low = (self.pairs.find(before, made) <= lowest) | (self.pairs.find(made, edged[at + 3]) <= lowest)
            if low.any():
                at = at[: int(low.argmax()) + 1]
            ids[at] = lowest
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, merged = ids[keep], at - np.arange(len(at))
            ranks = np.append(ranks, NONE)[keep][:-1]
            for near in (merged - 1, merged):
                near = near[(near >= 0) & (near < len(ids) - 1)]
                ranks[near] = self.pairs.find(ids[near], ids[near + 1])
        return ids.astype("<u4").tobytes()


def encode_documents(
    docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text", held: int = 400_000
) -> DataFrame:
    """(doc_id, n_tokens, ids) of every text; ids are little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is encoded by itself, without special tokens. Distinct matches of a batch that the worker
    does not hold yet go through the matrices; it holds up to ``held`` of them, then starts anew.

    A null or empty text has no ids. Null and repeated ids, and repeated rows, give a row each; an empty table none.
    Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    content, _, version = read_vocabulary(vocabulary)
    shipped = spark.sparkContext.broadcast(content)

    def run(batches):
        import regex

        encoder = built(version + "/matrix", lambda: MatrixEncoder(parse_ranks(shipped.value)))
        split, known = regex.compile(pattern), {}
        for batch in batches:
            parts = [split.findall(t.as_py()) for t in batch.column("text")]
            fresh = set().union(*parts) - known.keys() if parts else set()
            if len(known) + len(fresh) > held:
                known, fresh = {}, set().union(*parts)
            fresh = list(fresh)
            known.update(zip(fresh, encoder.encode([w.encode() for w in fresh]), strict=True))
            ids = [b"".join(map(known.__getitem__, p)) for p in parts]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "n_tokens", "ids"],
            )

    return texts(docs, doc_id, text).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for rows of ``encode_documents``; null ids decode to no bytes."""
    content, _, version = read_vocabulary(vocabulary)
    shipped = encoded.sparkSession.sparkContext.broadcast(content)

    def make():
        ranks = parse_ranks(shipped.value)
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        return tokens

    def run(batches):
        tokens = built(version + "/tokens", make)
        for batch in batches:
            decoded = [
                b"".join(map(tokens.__getitem__, np.frombuffer(x.as_py() or b"", "<u4").tolist()))
                for x in batch.column("ids")
            ]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("n_tokens"), batch.column("ids"), pa.array(decoded, pa.binary())],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, decoded binary"
    )


@query()
def op2_byte_pairs(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return decode_documents(encoded, path).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
