import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyframe.ranking import average_ranks, percentiles_by, running_total


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in np.round(rng.normal(0, 50, 3000), 2)] + [("hot", 1e9)]
    rows += [("flat", 4.0)] * 900 + [(f"k{i % 40}", float(v)) for i, v in enumerate(rng.uniform(-3, 3, 800))]
    return spark.createDataFrame(rows, "k string, v double").repartition(5).cache()


@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 0.77, 1.0])
def test_narrowed_percentiles_equal_numpy(values, share):
    rows = percentiles_by(values, ["k"], {"p": ("v", share)}, [F.count("v").alias("n")], limit=500).collect()
    pdf = values.toPandas()
    assert len(rows) == pdf.k.nunique()
    for r in rows:
        want = np.percentile(pdf.v[pdf.k == r.k], share * 100)
        assert r.p == pytest.approx(want, rel=1e-12, abs=1e-9)
        assert r.n == (pdf.k == r.k).sum()


def test_narrowed_percentile_without_keys(values):
    got = percentiles_by(values, [], {"a": ("v", 0.25), "b": ("v", 0.5)}, limit=100).first()
    v = values.toPandas().v
    assert (got.a, got.b) == pytest.approx((np.percentile(v, 25), np.percentile(v, 50)), rel=1e-12)


def test_running_total_by_partitions_equals_window(values):
    ids = values.withColumn("id", F.monotonically_increasing_id()).cache()
    order = [F.col("v"), F.col("id")]
    plain = running_total(ids, ["k"], order, F.col("v"), "t").select("id", F.round("t", 6).alias("t"))
    parted = running_total(ids, ["k"], order, F.col("v"), "t", limit=10).select("id", F.round("t", 6).alias("t"))
    assert sorted(plain.collect()) == sorted(parted.collect())
    numbered = running_total(ids, [], order, None, "no", limit=10)
    assert sorted(r.no for r in numbered.collect()) == list(range(1, ids.count() + 1))


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([(v,) for v in [3.0, 1.0, 3.0, 2.0, 3.0]], "v double")
    for limit in (None, 2):
        got = sorted((r.v, r.rk) for r in average_ranks(df, "v", "rk", limit).collect())
        assert got == [(1.0, 0.0), (2.0, 1.0), (3.0, 3.0), (3.0, 3.0), (3.0, 3.0)]
