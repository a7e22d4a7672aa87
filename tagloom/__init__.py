"""Annotated-text analytics on Spark DataFrames.

Functions of this package that run inside Python workers are shipped by value, so
executors need PySpark, pyarrow and numpy but not an installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
