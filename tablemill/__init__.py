"""Tabular ETL and data-quality operators for Spark: every operator maps DataFrames to DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Helpers that run inside tasks travel with the task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
