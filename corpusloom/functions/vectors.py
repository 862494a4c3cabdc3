"""Vector arithmetic in double precision on array columns."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_literal(values: Sequence[float]) -> Column:
    return F.lit([float(v) for v in values])


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    squares = F.aggregate(
        vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def cosine_distance(left: Column, right: Column) -> Column:
    return 1.0 - dot(left, right) / (norm(left) * norm(right))


def scale_to_unit(vector: Column) -> Column:
    length = norm(vector)
    return F.when(length > 0, F.transform(vector, lambda x: x.cast("double") / length))
