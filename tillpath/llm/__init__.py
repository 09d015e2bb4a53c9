"""Operators for preparing training text; nothing else in the package imports this one.

Functions that run on executors are sent along by value, so that a cluster needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
