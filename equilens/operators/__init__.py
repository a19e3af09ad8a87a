"""Operators: each is ``f(df, ...) -> DataFrame`` over Spark plans."""
