"""Document-collection analytics as plain PySpark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the jobs that use them, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
