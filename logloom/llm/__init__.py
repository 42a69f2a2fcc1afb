"""Operators for preparing training corpora. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# The operators' functions travel to the executors whole, so these need only the installed libraries.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
