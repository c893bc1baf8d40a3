"""tessera: a Spark-native engine for selecting, evaluating and preparing textual context."""

import sys

from pyspark import cloudpickle

#: Python functions of this package travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
