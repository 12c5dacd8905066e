"""lodestone: a Spark-first library of temporal-record, statistics, matching and ranking operators.

Every operator is a function from DataFrames to DataFrames, parameterised by
column roles, lazy unless its docstring says otherwise, and written so that
Catalyst chooses the physical strategy.
"""
