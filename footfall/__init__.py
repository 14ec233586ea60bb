"""Engagement and customer-value analytics as Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Executors receive the small numpy helpers with the task itself, so a cluster
# needs no copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
