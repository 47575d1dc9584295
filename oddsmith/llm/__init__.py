"""Operators for preparing training corpora. Nothing else in the library imports this subpackage.

Functions of this subpackage that run in tasks travel with the task (by value), so executors need
no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
