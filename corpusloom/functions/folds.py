"""Ordered folds over an array that collect results on the way."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import bind

STRETCH = 128


def record(current: Column, order: list[str], **changes) -> Column:
    """The struct ``current`` with some of its fields changed."""
    return F.struct(*[changes.get(n, current[n]).alias(n) for n in order])


def collecting_fold(
    items: Column,
    zero: dict[str, Column],
    kind: str,
    step: Callable[[Column, Column], Column],
    finish: Callable[[Column, Column], Column],
) -> Column:
    """Fold with the fields of ``zero`` plus ``done``, an array of type ``kind`` that ``step`` may append to.

    The engine copies the state of a fold at every element, so a long ``done`` would make it quadratic. The items are
    folded in stretches that start with an empty ``done``; what a stretch collected joins the rest once. Few items are
    one stretch as they are.
    ``finish`` gets the last state and all that was collected.
    """
    names = [*zero, "done"]
    none = F.array().cast(kind)
    stretches = F.when((F.size(items) >= 0) & (F.size(items) <= STRETCH), F.array(items)).otherwise(
        F.transform(
            F.filter(
                F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(STRETCH)),
                lambda i: i < F.size(items),
            ),
            lambda i: F.slice(items, i + 1, F.lit(STRETCH)),
        )
    )
    start = F.struct(
        F.struct(*[c.alias(n) for n, c in zero.items()], none.alias("done")).alias("state"), none.alias("all")
    )

    def add(acc: Column, stretch: Column) -> Column:
        return bind(
            F.aggregate(stretch, acc["state"], step),
            lambda end: F.struct(
                record(end, names, done=none).alias("state"), F.concat(acc["all"], end["done"]).alias("all")
            ),
        )

    return F.aggregate(stretches, start, add, lambda acc: finish(acc["state"], acc["all"]))


def append_if(condition: Column, acc: Column, items: Column) -> dict[str, Column]:
    """The field ``done`` with ``items`` added where the condition holds."""
    return {"done": F.when(condition, F.concat(acc["done"], items)).otherwise(acc["done"])}
