"""Byte-pair tokens of a model's own vocabulary: counts, chunks with byte offsets, and decoding.

A vocabulary is a file of ranks (one base64 token and its rank a line) and the pattern that splits texts before the merges.
The driver reads the file once and broadcasts its bytes, so that executors need neither a copy nor a network. Special tokens are
ordinary text, as in texts that are data. Texts are encoded in Arrow batches; other columns stay in the engine.
"""

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.rows import explode_once
from corpusloom.operators.tokens import CHUNK_TOKENS

#: A file of more bytes is refused: it would be no vocabulary, and it is broadcast.
MOST_BYTES = 64 << 20

_BUILT: dict[tuple[str, str], "_Encoder"] = {}  # of this worker process, by digest and pattern


class _Encoder:
    """Ids of a text, and the number of bytes of each id."""

    def __init__(self, content: bytes, pattern: str):
        import tiktoken

        lines = (line.split() for line in content.splitlines() if line)
        ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.pattern = pattern
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def ids(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.library.encode(text, disallowed_special=()), dtype=np.int32)
        except ValueError:
            # its matcher gives up at a million white-space characters in a row; pieces are encoded one by one then
            import regex

            pieces = regex.finditer(self.pattern, text)
            ids = [i for piece in pieces for i in self.library._encode_single_piece(piece.group())]
            return np.asarray(ids, dtype=np.int32)


def _encoder(content: bytes, digest: str, pattern: str) -> _Encoder:
    if (digest, pattern) not in _BUILT:
        _BUILT[digest, pattern] = _Encoder(content, pattern)
    return _BUILT[digest, pattern]


class BytePairs:
    """Column functions for one vocabulary."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as file:
            content = file.read(MOST_BYTES + 1)
        if len(content) > MOST_BYTES:
            raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
        self._content = spark.sparkContext.broadcast(content)
        self._key = (hashlib.sha256(content).hexdigest(), pattern)

    def _udf(self, result: str, body):
        content, key = self._content, self._key

        def run(values: pa.Array) -> pa.Array:
            return body(_encoder(content.value, *key), values)

        run.__annotations__ = {"values": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, result)

    def count(self, text: Column) -> Column:
        """Tokens of a text; NULL for NULL."""

        def counted(encoder, texts):
            return pa.array([None if not t.is_valid else len(encoder.ids(t.as_py())) for t in texts], pa.int32())

        return self._udf("int", counted)(text)

    def encode(self, text: Column) -> Column:
        """Ids of a text; NULL for NULL."""

        def encoded(encoder, texts):
            return pa.array([encoder.ids(t.as_py()) if t.is_valid else None for t in texts], pa.list_(pa.int32()))

        return self._udf("array<int>", encoded)(text)

    def decode(self, ids: Column) -> Column:
        """Bytes of ids; an id the vocabulary has not is an error. A chunk's bytes may begin or end within a character."""

        def decoded(encoder, lists):
            return pa.array(
                [b"".join(encoder.tokens[i] for i in row.as_py()) if row.is_valid else None for row in lists], pa.binary()
            )

        return self._udf("binary", decoded)(ids)

    def runs(self, text: Column, n: int) -> Column:
        """Consecutive runs of n ids, each with the first byte of the text it covers and the one after its last."""

        def cut(encoder, texts):
            ids, begins, ends, sizes, runs = [], [], [], [], [0]
            for t in texts:
                own = encoder.ids(t.as_py()) if t.is_valid else np.empty(0, np.int32)
                upto = np.concatenate([[0], np.cumsum(encoder.sizes[own])])
                starts = np.arange(0, len(own), n)
                stops = np.minimum(starts + n, len(own))
                ids.append(own)
                begins.append(upto[starts])
                ends.append(upto[stops])
                sizes.append(stops - starts)
                runs.append(runs[-1] + len(starts))
            edges = np.concatenate([[0], np.cumsum(np.concatenate([*sizes, np.empty(0, np.int64)]))])
            flat = pa.array(np.concatenate([*ids, np.empty(0, np.int32)]), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), flat)
            rows = pa.StructArray.from_arrays(
                [pa.array(np.concatenate([*x, np.empty(0, np.int64)]), pa.int64()) for x in (begins, ends)] + [lists],
                ["begin", "end", "token_ids"],
            )
            return pa.ListArray.from_arrays(pa.array(runs, pa.int32()), rows)

        return self._udf("array<struct<begin:bigint,end:bigint,token_ids:array<int>>>", cut)(text)


def byte_pair_counts(docs: DataFrame, pairs: BytePairs, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Byte-pair tokens per row; NULL for a NULL text, 0 for an empty one."""
    return docs.withColumn(out, pairs.count(F.col(text)))


def byte_pair_chunks(docs: DataFrame, pairs: BytePairs, n: int = CHUNK_TOKENS, text: str = "text") -> DataFrame:
    """Consecutive runs of n byte-pair tokens, the last one shorter, as (columns but the text, chunk, begin, end,
    token_ids, n_tokens).

    ``begin`` and ``end`` are offsets in the UTF-8 bytes of the text; the chunks of a text cover it without gaps. A NULL or
    empty text has none. A text is one value in its task, whatever its length; so are its ids.
    """
    if n < 1:
        raise ValueError("n must be at least one")
    carried = [c for c in docs.columns if c != text]
    rows = explode_once(docs, carried, pairs.runs(F.col(text), n), "chunk", "_run")
    return rows.select(*carried, "chunk", "_run.*").withColumn("n_tokens", F.size("token_ids"))
