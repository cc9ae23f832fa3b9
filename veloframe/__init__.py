"""Bike-share analytics as Spark DataFrame jobs.

Every public function takes DataFrames (or Columns) and returns a DataFrame (or
Column).  Operators are lazy except those that save a step to the shared folder when
called: quantiles and what rests on them, speed statistics, density, the fit, and most
of ``llm``.  No rows are collected to the driver.  Outside ``llm`` the only Python
function is the polyline decoder, on whole Arrow batches.
"""

__version__ = "0.1.0"
