"""Spark-first engine for curating language-model training data and judging the models trained on it.

Functions of the library reach the executors by value, so that a job needs no copy of it there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
