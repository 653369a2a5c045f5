"""Lodestone: data preparation, ranking and evaluation for recommendation corpora, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python kernels travel to the executors by value, so these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
