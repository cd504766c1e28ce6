"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Functions that run
inside tasks are pickled by value, so executors do not need the package
on their own path."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
