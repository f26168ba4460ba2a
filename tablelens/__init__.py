"""tablelens: turn any Spark table into answers.

Every operator takes and returns Spark DataFrames.  Driver-side collects are
limited to results whose size is bounded by the number of *columns* of a
table (profile rows, cut-offs, one-row KPIs), never by its number of rows.
"""

__version__ = "0.1.0"
