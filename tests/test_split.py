"""The stratified split: exact class quotas by hash order, whatever ranges the hash is counted in, without a shuffle of the rows."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from equilens.operators import split


@pytest.mark.parametrize("bits", [1, 3, 14])
@pytest.mark.parametrize("fraction", [0.0, 0.3, 1.0])
def test_split_is_the_rank_by_hash(spark, monkeypatch, bits, fraction):
    """Repeated rows stay together; null keys and a null class count like any other."""
    monkeypatch.setattr(split, "RANGE_BITS", bits)
    rows = [(i // 2 if i % 5 else None, i % 7, "ab"[i % 3 > 0] if i % 10 else None) for i in range(300)] + [(1, 1, "b")] * 25 + [(9, 9, "c")]
    df = spark.createDataFrame(rows, "k int, j int, y string")
    digest = lambda r: hashlib.md5(("|".join(str(v) for v in r[:2] if v is not None) + "strat:42").encode()).hexdigest()
    want = set()
    for y in {r[2] for r in rows}:
        own = [digest(r) for r in rows if r[2] == y]
        quota = math.floor(len(own) * fraction + 0.5)
        want |= {(y, h) for h in own if sum(x <= h for x in own) <= quota}
    got = [tuple(r) for r in split.stratified_split(df, ["k", "j"], "y", fraction).collect()]
    assert sorted(map(str, (g[:3] for g in got))) == sorted(map(str, rows))
    assert all(g[3] == ((g[2], digest(g)) not in want) for g in got)


def test_rows_are_neither_shuffled_nor_ordered(spark, monkeypatch):
    """The class and hash of every row were exchanged and sorted."""
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("y"))
    seen, real = [], split.written

    def kept(d, what):
        seen.append((what, real(d, what)))
        return seen[-1][1]
    monkeypatch.setattr(split, "written", kept)
    out = split.stratified_split(df, ["id"], "y")
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert [w for w, _ in seen] == ["hashed", "ranges", "ends", "cuts"]
    assert out.where("NOT is_train").count() == 900
