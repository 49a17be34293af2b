"""Spark-native code-graph and findings analytics."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python workers get the functions themselves, so executors need no copy of
# this package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
