"""Copies of text and code at scale. Functions are shipped to executors by value, so that these need no copy of the package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
