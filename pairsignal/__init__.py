"""Paired-recording signal analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions used inside map tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
