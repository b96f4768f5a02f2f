"""Customer-propensity analytics as Spark jobs.

Every step takes and returns DataFrames.  Nothing here pulls a table to the
driver; the only values that reach it are model weights, metrics and schemas.
"""

__version__ = "0.1.0"
