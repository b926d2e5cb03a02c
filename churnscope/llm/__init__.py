"""Operators of a large-scale training-data pipeline.

Thirteen operators, one module each, plus ``queries`` (the registered ``opN_``
queries) and ``common`` (small shared helpers).  Nothing outside this package
imports it.

Functions of this package that run in Python workers are pickled by value, so
executors need the third-party libraries but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
