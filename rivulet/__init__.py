"""Rivulet: Spark jobs for ensembles of monthly flow series."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel whole: the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
