"""Documents and vectors as CSV."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_documents_csv(docs: DataFrame, path: str, vector: str | None = None) -> None:
    """A10: CSV with quoted multi-line text; a vector is written as text."""
    out = docs.withColumn(vector, F.to_json(vector)) if vector else docs
    out.write.mode("errorifexists").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_documents_csv(spark: SparkSession, path: str, schema: str, vector: str | None = None) -> DataFrame:
    """A10: back with the given schema; the vector text becomes numbers. A vector is string in ``schema``."""
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return rows.withColumn(vector, F.from_json(vector, "array<double>")) if vector else rows
