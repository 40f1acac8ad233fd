"""Conversation analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run in Python workers travel with the task, so executors need no copy of
# this package.
register_pickle_by_value(sys.modules[__name__])
