"""Operators for preparing training corpora.

Functions of this subpackage run inside Spark's Python workers, so they are shipped by value:
executors need numpy, pyarrow and xxhash, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
