"""Operators for preparing training data. Nothing else in the library imports this package.

Functions of this package that run in Python workers travel by value, so executors need only the public libraries.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
