"""Spark-first engine for price comparison, hybrid retrieval and corpus preparation.

Functions that run on Python workers are shipped by value, so a cluster needs no copy of
this package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
