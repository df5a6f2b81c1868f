"""Spark-native analytics over long-term memory data.

Operators are plain functions from DataFrames to DataFrames; ``__spark_entry__``
at the repository top registers one query for each.
"""

import sys

from pyspark import cloudpickle

# Python workers get the functions of this package by value, so that a cluster
# needs no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
