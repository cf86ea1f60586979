"""Verified gzip analytics on Spark DataFrames.

Functions of this package travel to the executors by value, so that only the
driver needs it on its path."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
