"""linelens: exact line search and corpus processing on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors get our functions by value, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
