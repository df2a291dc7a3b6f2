"""pagefold: paged-document analytics expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Executors get the task functions by value, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
