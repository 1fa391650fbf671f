"""Operators of a training-data pipeline (extraction, filters, dedup, mixing, search).

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code, so executors need no copy of
# this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
