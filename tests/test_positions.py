"""Reference positions: trees of all sizes against NumPy, and how often the points are read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyframe.operators.singletree import reference_positions


def cloud():
    rng = random.Random(8)
    sizes = {-100: 60, 0: 60, 1: 39, 2: 40, 3: 400, 4: 90, 5: 120}
    rows = [(label, rng.random() * 9, rng.random() * 9, rng.random() * 4) for label, n in sizes.items() for _ in range(n)]
    return rows + [(6, float(i), 2.0 * i, 5.0 if i else 0.0) for i in range(50)]  # no foot band: all points count


def expected(rows):
    want = {}
    for label in {r[0] for r in rows} - {-100, 0}:
        x, y, z = np.array([r[1:] for r in rows if r[0] == label]).T
        band = (z - np.percentile(z, 2) >= 0.3) & (z - np.percentile(z, 2) <= 1.8)
        use = band if band.sum() >= 3 else np.ones(len(z), bool)
        if len(z) >= 40:
            want[label] = (np.median(x[use]), np.median(y[use]), len(z))
    return want


@pytest.mark.parametrize("limit", [None, 100])
def test_positions_equal_numpy(spark, limit):
    rows = cloud()
    points = spark.createDataFrame(rows, "label bigint, x double, y double, z double")
    got = {r["label"]: (r["x"], r["y"], r["n_points"]) for r in reference_positions(points, limit=limit).collect()}
    want = expected(rows)
    assert set(got) == set(want) == {2, 3, 4, 5, 6}
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_points_are_read_for_the_count_and_once_more(spark):
    rows = cloud()
    seen = spark.sparkContext.accumulator(0)

    def name(label):
        seen.add(1)
        return label

    points = spark.createDataFrame(rows, "label bigint, x double, y double, z double").withColumn(
        "label", F.udf(name, "bigint").asNondeterministic()("label"))
    assert reference_positions(points).count() == 5
    assert seen.value == 2 * len(rows)
