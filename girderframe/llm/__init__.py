"""Operators for training-data pipelines over documents, pages and embeddings."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this package with the task and need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
