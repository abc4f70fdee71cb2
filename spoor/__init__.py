"""Execution-trace analytics on Spark: recordings in, typed DataFrames and answers out."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
