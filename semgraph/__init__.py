"""Semantic-model queries and property-graph operators on Spark DataFrames.

Python functions of this package travel to the executors by value, which so need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
