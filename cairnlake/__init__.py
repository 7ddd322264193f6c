"""A Spark-native engine for code knowledge: property graph, lexical index, ranked retrieval."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
