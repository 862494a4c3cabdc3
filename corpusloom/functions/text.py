"""Text and array expressions shared by the operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: one token is a word or a single other visible sign
TOKEN_PATTERN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Referring to a costly column inside a lambda would let the optimizer inline it there and evaluate it per
    element; a lambda variable is evaluated once. The value is the start of a fold over nothing and the body is its last
    step: neither is copied, while a fold copies its state at every element and a transform its results.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN_PATTERN))


def null_if_empty(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def python_literal(text: Column) -> Column:
    """Quoted form of a string as Python prints it."""
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    only_single = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(only_single, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def python_tuple(items: Column) -> Column:
    """Array shown as a Python tuple; NULL shown as None."""
    shown = F.array_join(F.transform(items, python_literal), ", ")
    closing = F.when(F.size(items) == 1, F.lit(",)")).otherwise(F.lit(")"))
    return F.coalesce(F.concat(F.lit("("), shown, closing), F.lit("None"))


def line_breaks_to_space(text: Column) -> Column:
    """Newlines and literal backslash-n become spaces, then two passes of double to single space."""
    out = F.replace(text, F.lit("\n"), F.lit(" "))
    out = F.replace(out, F.lit("\\n"), F.lit(" "))
    out = F.replace(out, F.lit("  "), F.lit(" "))
    return F.replace(out, F.lit("  "), F.lit(" "))
