"""Software-history analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions run in tasks travel with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
