"""Conversation analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so nothing needs
# to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
