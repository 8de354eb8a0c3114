"""Vector search and ANN evaluation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Kernels travel to the Python workers inside their task closures, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
