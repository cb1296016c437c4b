"""Training-data operators: sharding, mixing, language ID, near-duplicate joins,
toxicity, quality rules, nearest neighbours, token counts, licence scans and
SentencePiece encoding.  Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need
# numpy, pandas and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
