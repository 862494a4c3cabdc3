"""Fixed schemas of the tables this library reads and writes."""

from pyspark.sql import types as T

CODE_TYPES = ("function", "class", "method", "global", "select", "insert", "update", "delete")

BLOCK = T.StructType(
    [
        T.StructField("code_type", T.StringType()),
        T.StructField("function_name", T.StringType()),
        T.StructField("class_name", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("inputs", T.ArrayType(T.StringType())),
        T.StructField("outputs", T.ArrayType(T.StringType())),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("owner_class", T.StringType()),
        T.StructField("all_bases", T.ArrayType(T.StringType())),
    ]
)

INDEX = T.StructType(
    [
        T.StructField("repo_id", T.StringType()),
        T.StructField("filepath", T.StringType()),
        T.StructField("file_checksum", T.StringType()),
        T.StructField("block_id", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("language", T.StringType()),
        *BLOCK.fields,
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("code_embedding", T.ArrayType(T.FloatType())),
    ]
)

BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

CODE_FILE = T.StructType(
    [
        T.StructField("repo_id", T.StringType()),
        T.StructField("filepath", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("modified", T.TimestampType()),
    ]
)

MESSAGE = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
