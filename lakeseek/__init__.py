"""lakeseek: document chunking, versioning and hybrid retrieval on PySpark DataFrames.

Functions that run on Python workers are pickled by value, so a cluster needs
no installed copy of this package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
