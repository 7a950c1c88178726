"""Document search and analytics on PySpark DataFrames.

Functions that run in Python workers are sent to them by value, so executors don't need the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
