import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import quantiles as Q


def values(seed):
    r = np.random.default_rng(seed)
    rows = [("hot", float(x)) for x in np.exp(r.normal(size=3000) * 8)]
    rows += [("tied", float(x)) for x in r.integers(0, 3, 900)] + [("one", 5.0)] + [("same", -2.5)] * 500
    rows += [(None, float(x)) for x in r.normal(size=401)] + [("gone", None), ("gone", float("nan")), ("hot", None)]
    return rows + [("wide", x) for x in (-1e308, 1e308, 0.0, 1e-300, -0.0, 1e-308, 5e-324)] * 30


@pytest.mark.parametrize("bins, few", [(1024, 10_000), (64, 40)])
def test_equal_to_percentile(spark, bins, few):
    df = spark.createDataFrame(values(bins), "station string, x double").repartition(6)
    wanted = [0.0, 0.25, 0.5, 0.77, 1.0]
    got = {(r.station, r.quantile): r.value for r in Q.exact_quantiles(df, ["station"], "x", wanted, bins, few).collect()}
    groups = {}
    for k, x in values(bins):
        groups.setdefault(k, []).append(x)
    assert len(got) == len(groups) * len(wanted)
    for (k, q), found in got.items():
        x = np.sort([v for v in groups[k] if v is not None and not np.isnan(v)])
        if not len(x):
            assert found is None
            continue
        at = q * (len(x) - 1)
        lo, hi = x[int(np.floor(at))], x[int(np.ceil(at))]
        part = at - np.floor(at)
        assert found == pytest.approx(lo if lo == hi else (1 - part) * lo + part * hi, rel=1e-12, abs=1e-320)


def test_no_task_holds_a_hot_group(spark):
    """One station with a third of all rows: what leaves the tasks is a count per bin, not its rows."""
    df = spark.range(30_000).selectExpr("IF(id % 3 = 0, 'hot', concat('s', id % 500)) AS station", "rand(1) AS x").repartition(8)
    rows = df.select(F.struct("station").alias("g"), F.col("x").alias("v"))
    ranges = rows.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    counts = Q._counts(rows, ranges, 64)
    assert counts.groupBy("g").count().agg(F.max("count")).first()[0] <= 64
    assert counts.agg(F.sum("n")).first()[0] == 30_000
    exact = df.groupBy("station").agg(F.median("x").alias("m"))
    got = Q.exact_quantiles(df, ["station"], "x", [0.5], 64, 100).join(exact, "station")
    assert got.count() == exact.count() and got.where("abs(value - m) > 1e-15").isEmpty()


def test_whole_table_and_empty_table(spark):
    df = spark.range(101).selectExpr("cast(id AS double) AS x")
    assert Q.exact_quantiles(df, [], "x", [0.5], 4, 5).collect()[0] == (0.5, 50.0)
    assert Q.exact_quantiles(df.where("x < 0").withColumn("k", F.lit(1)), ["k"], "x", [0.5]).isEmpty()
