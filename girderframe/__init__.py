"""girderframe: Spark-native analytics for building- and plant-model data.

Every operator is a function from DataFrames to DataFrames, built from public
Spark operations, so that Catalyst plans it and the work is partitioned.
"""

__version__ = "0.1.0"
