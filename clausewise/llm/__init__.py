"""Operators for preparing large text corpora for model training.

Functions of this package that run on executors are shipped by value, so a
cluster's workers need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
