import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faceoff.operators.ordering import exact_quantiles

PROBS = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]


def groups():
    rng = np.random.default_rng(3)
    return {
        "plain": rng.normal(size=4000), "outlier": np.append(rng.random(3999), 1e300), "ties": rng.integers(0, 3, 4000).astype(float),
        "one": np.array([7.0]), "two": np.array([1.0, 4.0]), "same": np.full(3000, 2.5), "skew": np.exp(rng.normal(size=4000) * 20)}


@pytest.mark.parametrize("accuracy", [100, 1000, 10_000])
def test_quantiles_equal_numpy(spark, accuracy):
    own = groups()
    rows = [(k, float(x)) for k, v in own.items() for x in v] + [("plain", None), ("none", None)]
    got = exact_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", PROBS, accuracy).collect()
    want = {(k, p): np.quantile(v, p) for k, v in own.items() for p in PROBS}
    assert len(got) == len(want) and all(r["value"] == pytest.approx(want[r["k"], r["prob"]], rel=1e-12) for r in got)


def test_one_outlier_leaves_few_rows_to_rank(spark):
    """Between two splitters lies a small share of the rows, however far one value is from the others."""
    n, accuracy = 100_000, 1000
    df = spark.range(n).select(F.when(F.col("id") == 0, 1e300).otherwise(F.rand(5)).alias("v"))
    out = exact_quantiles(df, [], "v", [0.25, 0.5], accuracy)
    plan = out._jdf.queryExecution()
    out.collect()
    ends = [0.5 - 3 / accuracy, 0.5 + 3 / accuracy]
    lo, hi = df.agg(F.percentile_approx("v", ends, accuracy)).first()[0]
    assert df.where(F.col("v").between(lo, hi)).count() <= n * 8 / accuracy + 1 and "percentile_approx" in plan.toString()
    assert out.count() == 2


def test_quantiles_do_not_depend_on_the_order_of_arrival(spark):
    """On a cluster parts arrive in another order each time they are read; a sketch read twice has other splitters then."""
    def stirred(batches):
        rows = pa.Table.from_batches(batches)
        yield from rows.take(np.random.default_rng().permutation(len(rows))).to_batches()

    n = 400_000         # a sketch takes in 50,000 rows of a key at once
    rows = spark.range(0, n, 1, 2).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 400_009).cast("double").alias("v"))
    reuse = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        for few in (False, True):
            got = exact_quantiles(rows.mapInArrow(stirred, rows.schema), ["k"], "v", PROBS, 1000, few).collect()
            own = {k: np.arange(k, n, 2) * 7919.0 % 400_009 for k in (0, 1)}
            assert {(r["k"], r["prob"]): r["value"] for r in got} == pytest.approx({(k, p): np.quantile(v, p) for k, v in own.items() for p in PROBS})
    finally:
        spark.conf.set("spark.sql.exchange.reuse", reuse)
