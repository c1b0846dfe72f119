"""Operators for preparing training corpora; nothing outside this folder imports it."""
import sys

from pyspark import cloudpickle

# Ship this folder's helpers with the jobs, so that executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
