"""Model training and scoring as Spark jobs."""

import hydrolake
from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(hydrolake)
