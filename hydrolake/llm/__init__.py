"""Training-data operators: scoring, deduplication, decontamination, tokenizing, formatting and vector search."""

from pyspark import cloudpickle

import hydrolake

# Functions sent to Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(hydrolake)
