"""Spark-native retrieval, audit and security analytics over DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions travel with their tasks, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
