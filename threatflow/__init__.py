"""Security-event analytics as Spark DataFrame, streaming and spark.ml jobs."""

import sys

from pyspark import cloudpickle

# Task functions travel whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
