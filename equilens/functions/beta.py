"""Beta sequences for the power / log / arcsin feature transforms.

The E sequences are functions of consecutive residues ``p^k mod q``, k = 2..q, without 1 and
q - 1.  They are built as a table ``(idx, beta)``: residues from a sequence of exponents,
neighbours by ``lead``, one expression for each mode.  A sequence holds at most q (= 173) numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def residue_table(spark: SparkSession, p: int, q: int) -> DataFrame:
    """``(k, a, b, c)``: each kept residue with the next two.

    The power is a fold over the exponent's steps, kept below ``q`` all along.
    """
    power = F.aggregate(F.sequence(F.lit(1), F.col("k")), F.lit(1).cast("long"), lambda acc, _: (acc * p) % q)
    kept = spark.range(2, q + 1).select(F.col("id").cast("int").alias("k")).select("k", power.alias("r")) \
        .where(~F.col("r").isin(1, q - 1))
    w = Window.orderBy("k")                     # q rows at most
    return kept.select("k", F.col("r").cast("double").alias("a"), F.lead("r", 1).over(w).cast("double").alias("b"),
                       F.lead("r", 2).over(w).cast("double").alias("c"))


def _modes() -> dict[str, Column]:
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return {
        "E1": a,
        "E2": a / b,
        "E3": a / (a + b),
        "E4": F.abs(a - b),
        "E5": F.abs((a - b) / (a + b)),
        "E6": 1 / a,
        "E7": 1 / a + 1 / b,
        "E8": a * b / (a + b),
        "E9": (a + b + c) / (a * b * c),
    }


def beta_table(spark: SparkSession, mode: str, p: int = 102, q: int = 173, emin: float = 0.5, emax: float = 2.0,
               order: int = 0, length: int = 10) -> DataFrame:
    """``(idx, beta)`` of one sequence.

    d4A: the odd numbers from 3; d4B: their reciprocals (``length`` of them).  E1..E9: the
    mode's values strictly between ``emin`` and ``emax``, by exponent (order 0), rising (1) or
    falling (-1); the order does not touch d4A and d4B.
    """
    odd = F.col("id") * 2 + 3
    d4 = {"d4A": odd.cast("double"), "d4B": 1 / odd}
    if mode in d4:
        return spark.range(length).select(F.col("id").cast("int").alias("idx"), d4[mode].alias("beta"))
    expr = _modes().get(mode)
    if expr is None:
        raise ValueError(f"unsupported stream mode: {mode}")
    vals = residue_table(spark, p, q).select("k", expr.alias("beta")).where((F.col("beta") > emin) & (F.col("beta") < emax))
    by = {0: [F.col("k")], 1: [F.col("beta"), F.col("k")], -1: [F.desc("beta"), F.col("k")]}[order]
    return vals.select((F.row_number().over(Window.orderBy(*by)) - 1).cast("int").alias("idx"), "beta")


def beta_stream(mode: str, p: int = 102, q: int = 173, emin: float = 0.5, emax: float = 2.0, order: int = 0,
                length: int = 10, spark: SparkSession | None = None) -> list[float]:
    """The sequence as numbers, to stand as literals in transform expressions."""
    spark = spark or SparkSession.active()
    rows = beta_table(spark, mode, p, q, emin, emax, order, length).collect()
    return [r["beta"] for r in sorted(rows, key=lambda r: r["idx"])]
