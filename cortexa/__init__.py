"""Spark-native analytics for node-level signals, networks and labelled tables."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
