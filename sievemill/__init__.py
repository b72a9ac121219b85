"""sievemill: evidence extraction from web pages as Spark DataFrame operations."""

import sys

from pyspark import cloudpickle

# Executors need not have the package installed: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
