"""Operators for preparing language-model training data.

Functions of this subpackage that run in Python workers are sent to them by value, so executors
don't need it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
