"""cohortkit: observational cohort-study operators on Spark DataFrames.

Row-level work stays in Spark (DataFrame / SQL / Spark ML); only small
aggregates (per-time tables, p x p matrices, cut points) reach the driver.
"""

__version__ = "0.1.0"
