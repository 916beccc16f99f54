"""Service-request analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks carry their code along, so executors needn't have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
