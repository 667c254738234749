"""lanternspark: retrieval-augmented text analytics on plain PySpark.

Everything takes and returns DataFrames.  The sub-package ``llm`` (training-data
operators) is optional: nothing outside of it imports it.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to executors by value, so executors need not have it installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
