"""vocalframe: speech-evaluation table work as PySpark DataFrame jobs."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.1.0"

# Python workers receive our Arrow UDFs by value, so executors need no copy of
# the package on their path (no --py-files step on the cluster).
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
