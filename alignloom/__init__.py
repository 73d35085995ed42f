"""Spark-native engine for pairwise-alignment chains."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers whole, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
