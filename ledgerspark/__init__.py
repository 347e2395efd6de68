"""Ledger analytics on Spark.

The package's functions travel to Python workers by value, so workers need not
have it installed."""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
