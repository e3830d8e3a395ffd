"""parlance: transcript analytics and verification on Spark DataFrames."""

import os
import sys

from pyspark import cloudpickle

#: Python workers import the package by name where PYTHONPATH has it; anywhere else its functions travel by value.
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if _ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
