"""Operators of a training-data pipeline. Nothing outside this subpackage imports it.

Functions of this subpackage are sent to executors by value, so a cluster needs
no copy of the package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
