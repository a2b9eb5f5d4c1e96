"""Freight performance and profitability analytics on Spark DataFrames.

Every operator takes DataFrames (or Columns) and returns them lazily: nothing
here collects rows, and no Python code runs per row.
"""

from lanewise.session import local_session

__all__ = ["local_session"]
