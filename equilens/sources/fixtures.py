"""Fixture views over the TPC-H-style test tables.

Each view is a lazy DataFrame; joins are equi-joins on keys with only the
needed columns selected so that the parquet scans are pruned.  The join
strategy is left to Catalyst/AQE, which broadcasts a side only when its
measured size is under ``spark.sql.autoBroadcastJoinThreshold``; the audit
rows' joins are shuffled hash joins at any size, so nothing is sorted or spilled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.spec import AuditSpec

SCORED_PROTECTED = ("l_linestatus", "o_orderpriority", "c_mktsegment")
AUDIT_SPEC = AuditSpec(
    target="o_totalprice",
    protected=("o_orderpriority", "c_mktsegment"),
    numerical=("l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_retailprice"),
    categorical=("l_returnflag", "l_linenumber", "p_type", "p_brand"),
    key=("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"),
)
DOCS_SPEC = AuditSpec(target="toxic", protected=("lang", "source"), numerical=("n_chars",),
                      categorical=("quality",), key=("doc_id",))
LINEITEM_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_orders_customer(spark, sf_dir, li_cols, o_cols, c_cols, hashed: bool = False) -> DataFrame:
    """``hashed``: the smaller sides are hashed, so the lineitems are not sorted, which spills once they are many."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *[c for c in li_cols if c != "l_orderkey"])
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey",
                                              *[c for c in o_cols if c not in ("o_orderkey", "o_custkey")])
    c = table(spark, sf_dir, "customer").select("c_custkey", *[x for x in c_cols if x != "c_custkey"])
    # customers join the orders first: the lineitems, the largest side, are exchanged once less
    if hashed:
        c = c.hint("shuffle_hash")
    oc = o.join(c, o.o_custkey == c.c_custkey)
    if hashed:
        oc = oc.hint("shuffle_hash")
    return li.join(oc, F.col("l_orderkey") == F.col("o_orderkey"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored table: label_Y, pred_Y, score_S (+ exact integer score_pct) and 3 protected columns."""
    df = lineitem_orders_customer(
        spark, sf_dir,
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_linestatus"],
        ["o_orderpriority"], ["c_mktsegment"])
    pct = (F.col("l_partkey") * 7 + F.col("l_suppkey") * 13 + F.col("l_linenumber") * 29) % 101
    return df.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        (F.col("l_quantity") > 25).cast("int").alias("label_Y"),
        (pct >= 50).cast("int").alias("pred_Y"),
        pct.cast("long").alias("score_pct"),
        (pct / F.lit(100.0)).alias("score_S"),
        *SCORED_PROTECTED,
    )


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature table for epsilon / transforms / re-bins (lineitem x orders x customer x part)."""
    base = lineitem_orders_customer(
        spark, sf_dir,
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
         "l_discount", "l_tax", "l_returnflag"],
        ["o_orderpriority", "o_totalprice"], ["c_mktsegment"], hashed=True)
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_retailprice").hint("shuffle_hash")
    df = base.join(p, F.col("l_partkey") == F.col("p_partkey"))
    return df.select("l_orderkey", "l_partkey", "l_suppkey", *AUDIT_SPEC.numerical,
                     *AUDIT_SPEC.categorical, *AUDIT_SPEC.protected, AUDIT_SPEC.target)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return d.join(lab, "doc_id")


def nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`audit` with injected nulls and one all-null column."""
    a = audit(spark, sf_dir)
    return (a.withColumn("l_returnflag", F.expr("nullif(l_returnflag, 'N')"))
             .withColumn("l_discount", F.expr("nullif(l_discount, 0.05D)"))
             .withColumn("all_null", F.lit(None).cast("double")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
