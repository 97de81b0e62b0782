"""Operators that prepare training text. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need only Spark and the public Python packages.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
