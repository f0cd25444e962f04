"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so their Python workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
