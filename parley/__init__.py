"""Conversation analytics on Spark: threads, labels, retrieval, evaluation."""

import sys

from pyspark import cloudpickle

# Task functions travel inside the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
