"""A Spark-native search and text-analytics engine."""

import sys

from pyspark import cloudpickle

# Python workers get the package's functions inside the task, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
