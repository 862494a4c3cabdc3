"""Corpus indexing and retrieval on Spark: tables in, DataFrames out."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers travel with their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
