"""rastra: image files and training corpora as Spark tables."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the query, so that they need no install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
