"""Operators: functions from DataFrames to DataFrames over the relations of :mod:`loomtable.operators.cells`."""
