"""Operators for preparing training text: extraction, scoring, deduplication, packing, sharding."""

import sys

from pyspark import cloudpickle

# Task functions carry their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
