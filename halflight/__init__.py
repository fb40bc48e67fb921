"""halflight: learning from a small labelled table and a large unlabelled one, on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run inside Python workers travel by value, so a cluster needs
# no copy of this package on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
