"""Operators for the preparation of language-model training data. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors with their code, so that these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
