"""Operators for the preparation of training data, and their queries.

Nothing else in the library imports this package.  The functions it sends to
Spark's Python workers travel by value, so the workers need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
