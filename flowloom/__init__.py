"""Flow-log analytics and training-data operators as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors whole, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
