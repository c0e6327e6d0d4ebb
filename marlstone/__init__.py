"""Marlstone: retrieval, record and evaluation analytics as DataFrame -> DataFrame operators on Spark."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel by value: executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
