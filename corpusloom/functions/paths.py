"""File path expressions and ignore rules."""

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def suffix(path: Column) -> Column:
    """Last extension with its dot, empty when the base name has none (a leading dot starts a name)."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def directory_prefixes(path: Column) -> Column:
    """Every directory above the file, outermost first: a/b/c.py -> [a, a/b]."""
    parts = F.split(path, "/")
    return F.transform(
        F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i > 0),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
    )


@dataclass(frozen=True)
class IgnoreRule:
    pattern: str
    regex: str
    negated: bool


def compile_ignore_rules(lines: Iterable[str]) -> list[IgnoreRule]:
    """Ignore-file lines as regular expressions over slash separated relative paths.

    Directories are tested with a trailing slash, so a rule ending in ``/`` applies to directories only.
    """
    rules = []
    for line in lines:
        pattern = line.rstrip("\n").rstrip()
        if not pattern or pattern.startswith("#"):
            continue
        negated = pattern.startswith("!")
        glob = pattern[1:] if negated else pattern
        only_dirs = glob.endswith("/")
        glob = glob.rstrip("/")
        anchored = "/" in glob
        parts = [p for p in glob.split("/") if p]
        if not parts:
            continue
        head = "" if anchored else "(?:.*/)?"
        body = ""
        for number, part in enumerate(parts):
            if part == "**":
                body += ".*" if number == len(parts) - 1 else "(?:.*/)?"
                continue
            body += _segment(part) + ("/" if number < len(parts) - 1 else "")
        tail = "/.*" if only_dirs else "(?:/.*)?"
        rules.append(IgnoreRule(pattern, f"^{head}{body}{tail}$", negated))
    return rules


def _segment(part: str) -> str:
    """One path segment of a glob as a regular expression."""

    def convert(found: re.Match) -> str:
        sign = found.group(0)
        if sign == "*":
            return "[^/]*"
        if sign == "?":
            return "[^/]"
        if sign.startswith("["):
            inner = sign[1:-1]
            return "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]"
        return re.escape(sign.lstrip("\\") or sign)

    return re.sub(r"\\.|\[[^\]]+\]|[\s\S]", convert, part)


def ignored(path: Column, rules: list[IgnoreRule]) -> Column:
    """Verdict of the last rule that matches."""
    verdict = F.lit(False)
    for rule in rules:
        verdict = F.when(path.rlike(rule.regex), F.lit(not rule.negated)).otherwise(verdict)
    return verdict
