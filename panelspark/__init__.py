"""Macro panels, posterior draws and policy scenarios as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few batch functions travel to the workers by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
