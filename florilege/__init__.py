"""A Spark-native engine for auditing, profiling, matching and reconciling digital collections."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
