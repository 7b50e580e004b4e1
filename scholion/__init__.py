"""Scholion: literature ingestion, search and retrieval-context jobs on Spark DataFrames.

Every operator is a function from DataFrames (or Columns) to DataFrames (or Columns);
nothing here runs outside Spark.
"""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
