"""Waymark: column lineage, change impact and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to executors travel by value, so workers need no copy of the package.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
