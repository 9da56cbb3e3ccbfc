"""kerfspark: set-based analytics over panel drawings, process diagrams and the data made from them."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
