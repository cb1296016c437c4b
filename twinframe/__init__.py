"""A Spark-native dataset comparison engine."""

import sys

from pyspark import cloudpickle

# Python functions used inside plans travel by value, so executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
