"""Spark jobs that turn chat exports into a searchable, citable knowledge base."""

import sys

from pyspark import cloudpickle

from colloquy.session import configure

__all__ = ["configure"]

# Functions sent to tasks travel whole: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
