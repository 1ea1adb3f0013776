"""Operators for preparing training text, independent of the change-detection engine.

Worker functions of this package travel to the executors by value, so executors
need only Python, numpy and pyarrow, not an installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
