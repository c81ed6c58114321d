"""Operators for preparing training text."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors inside the tasks, so that
# executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
