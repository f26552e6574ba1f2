"""Spark-native analytics for terrain-derived drainage networks."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that only the driver needs it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
