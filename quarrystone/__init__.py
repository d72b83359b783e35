"""quarrystone: vector and full-text retrieval over collections, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions go to the workers by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
