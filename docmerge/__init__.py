"""Document grouping, extraction, merging and reshaping as Spark jobs."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value, so they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
