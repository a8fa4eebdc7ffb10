"""Realized volatility and forecast comparison as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package that run inside tasks travel with the job, so that executors
# need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
