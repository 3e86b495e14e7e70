"""Spark-native engine that reconstructs publicly funded works from scattered records."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
