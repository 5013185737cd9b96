"""Page-orientation analytics over large document collections, written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python workers, and the process that prepares keyed streaming state, need not have this
# package installed: its functions and state processors travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
