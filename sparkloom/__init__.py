"""A PySpark-native data-intelligence engine: cleaning, profiling, join discovery, retrieval, guards and text mining."""

import sys

from pyspark import cloudpickle

# Python workers get the library's functions by value, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
