"""Delimited-file and schema-drift repair on Spark.

The package is pickled by value, so Python workers need no copy of it on
their own path."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
