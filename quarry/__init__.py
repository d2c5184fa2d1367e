"""A PySpark-native analytics engine: a strict SQL dialect over a versioned Parquet store."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors whole, which then need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
