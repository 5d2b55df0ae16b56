"""Spark-native analytics over time-stamped, multi-topic recordings."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions that tasks run travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
