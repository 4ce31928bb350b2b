"""Metered-utility consumption analytics as Spark jobs.

Bills -> account-month facts -> series -> backtest -> projection.  Every
operator is a function from DataFrames to a DataFrame; nothing is executed
until a caller writes or reads the result.
"""
