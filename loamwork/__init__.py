"""A Spark-first engine for prediction scoring, causal estimates, claim graphs and gridded data."""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value: no executor needs this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
