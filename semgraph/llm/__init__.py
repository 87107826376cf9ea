"""Operators of a training-data pipeline: deduplication, decontamination, tokens, quality, extraction.

Python functions of this package travel to the executors by value, so that these need the
libraries (pyarrow, numpy, xxhash, sentencepiece) and no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
