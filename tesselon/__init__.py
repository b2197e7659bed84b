"""Tile and feature analytics expressed as Spark DataFrame plans.

Functions that run in Spark's Python workers are shipped by value: executors need numpy, pandas and
pyarrow, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
