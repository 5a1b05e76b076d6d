"""Corpus analytics and training-data preparation as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that a cluster needs no copy of it on its machines.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
