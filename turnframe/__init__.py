"""turnframe: conversations as token tables on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value: a cluster need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
