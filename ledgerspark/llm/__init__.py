"""Operators for preparing training corpora. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Executors need not have this repository: functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
