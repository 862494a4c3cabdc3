"""Loading public vocabulary files in tasks.

The driver reads the file once and broadcasts its bytes (one file, a few MB), so that executors need no copy of it and
all of them use the version whose digest is recorded. A worker builds the tokenizer once.
"""

from __future__ import annotations

import base64
import hashlib
import json

#: Splitting rule of byte-level vocabularies (fixed value, that of the public GPT-2 tokenizer).
BYTE_LEVEL_PATTERN = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)

_BUILT: dict[str, object] = {}


def read_vocabulary(path: str) -> tuple[bytes, str, str]:
    """(content, kind, digest) of a vocabulary file; the kind is its name's ending."""
    with open(path, "rb") as file:
        content = file.read()
    return content, path.rpartition(".")[2], hashlib.sha256(content).hexdigest()


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a .tiktoken file."""
    ranks = {}
    for line in content.splitlines():
        if line:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


def _byte_signs() -> dict[str, int]:
    """Sign of every byte in byte-level files: itself if printable, else the next sign from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in plain}
    for n, b in enumerate(sorted(set(range(256)) - set(plain))):
        signs[chr(256 + n)] = b
    return signs


def _as_ranks(spec: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Ranks and special tokens of a plain byte-level BPE file, None for any other kind.

    Plain: no normalizer, the usual splitting, no word affixes, and merged tokens numbered in the order of the merges,
    so that the lowest id among adjacent pairs is the merge with the highest priority.
    """
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if (
        model.get("type") != "BPE"
        or spec.get("normalizer")
        or pre.get("type") != "ByteLevel"
        or pre.get("add_prefix_space")
        or not pre.get("use_regex", True)
        or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    ):
        return None
    signs, vocab = _byte_signs(), model["vocab"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized")):
        return None
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(set(merged)) or len(merged) + 256 != len(vocab.keys() - special.keys()):
        return None
    ranks = {bytes(signs[c] for c in token): i for token, i in vocab.items() if token not in special}
    return ranks, special


def _general(content: bytes):
    """ids of a text as the general library gives them, for any .json file."""
    from tokenizers import Tokenizer

    general = Tokenizer.from_str(content.decode())
    general.no_truncation()
    general.no_padding()
    return lambda text: general.encode(text, add_special_tokens=False).ids


def _piecewise(encoder):
    """ids of a text whose pieces are split by another library, which has no limit on white space in a row."""
    import regex

    split = regex.compile(BYTE_LEVEL_PATTERN)
    return lambda text: [i for piece in split.findall(text) for i in encoder._encode_single_piece(piece)]


def _or_else(first, make):
    """``first``, or what ``make`` returns where it gives up: the faster library does at a million white-space characters
    in a row. ``make`` is called at the first such text."""
    made = []

    def ids(text: str) -> list[int]:
        try:
            return first(text)
        except ValueError:
            if not made:
                made.append(make())
            return made[0](text)

    return ids


class LibraryEncoder:
    """ids of a text as the library of the file gives them."""

    def __init__(self, content: bytes, kind: str):
        self.ids = None
        if kind == "json":
            plain = _as_ranks(json.loads(content))
            if plain:
                import tiktoken

                # Same vocabulary, same splits and merges, several times faster than the general library.
                encoder = tiktoken.Encoding(
                    "own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=plain[0], special_tokens=plain[1]
                )
                fast = lambda text: encoder.encode(text, allowed_special="all", disallowed_special=())
                self.ids = _or_else(fast, lambda: _general(content))
            else:
                self.ids = _general(content)
        elif kind == "model":
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.ids = lambda text: pieces.encode(text)
        elif kind == "tiktoken":
            import tiktoken

            plain = tiktoken.Encoding(
                "own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=parse_ranks(content), special_tokens={}
            )
            # Not encode_ordinary, which panics where this raises an error; there are no special tokens.
            self.ids = _or_else(lambda text: plain.encode(text, disallowed_special=()), lambda: _piecewise(plain))
        else:
            raise ValueError(f"unknown kind of vocabulary: {kind}")


def built(digest: str, make):
    """What ``make`` returns, built once in a worker for each digest."""
    if digest not in _BUILT:
        _BUILT.clear()
        _BUILT[digest] = make()
    return _BUILT[digest]
