"""Operators for training-data pipelines.

Functions of this folder that run in Spark's Python workers are sent along with
the job, so the workers need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
