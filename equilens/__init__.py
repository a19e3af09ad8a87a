"""equilens: fairness audit and debiasing expressed as Spark DataFrame plans.

Every operator is a function ``f(df, ...) -> DataFrame`` built from Spark SQL
expressions, aggregates, windows and joins; nothing is collected to the driver
except small scalars (thresholds, selected attribute names, bin edges).
"""

__all__ = ["session", "spec"]
