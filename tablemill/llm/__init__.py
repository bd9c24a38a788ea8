"""Training-data operators: functions from DataFrames to DataFrames. Nothing else in the library imports this package."""
