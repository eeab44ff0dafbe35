"""Species forest on planted colours, habitat types against their centres."""

import random

import numpy as np
from pyspark.sql import functions as F

from canopyframe.operators import forest, learning


def test_forest_finds_planted_species(spark):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        kind = rng.choice(["birch", "pine", "spruce"])
        centre = {"birch": (90, 40), "pine": (60, 70), "spruce": (30, 50)}[kind]
        rows.append((i, kind if rng.random() > 0.05 else rng.choice(["birch", "pine", "spruce"]), *(rng.gauss(c, 9) for c in centre), rng.random()))
    df = learning.group_split(spark.createDataFrame(rows, "image_id bigint, label string, a double, b double, noise double"), "image_id")
    scored = learning.cross_species(df, ["a", "b", "noise"], "label", "image_id", trees=30).join(df, "image_id")
    accuracy = learning.class_report(scored, "label", "species").first()["accuracy"]
    assert accuracy >= 0.85
    shuffled = df.drop("label").join(df.select((F.col("image_id") * 7 % 240).alias("image_id"), "label"), "image_id")
    guessed = learning.cross_species(shuffled, ["a", "b", "noise"], "label", "image_id", trees=30).join(shuffled, "image_id")
    assert learning.class_report(guessed, "label", "species").first()["accuracy"] <= 0.55  # labels that say nothing can't be learned


def test_parts_of_a_forest_vote_as_one(spark, monkeypatch):
    rows = [(i, i % 2, float(i % 3), "abc"[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "image_id int, fold int, x double, label string")
    grown, fit = [], learning.RandomForestClassifier.fit
    monkeypatch.setattr(learning.RandomForestClassifier, "fit", lambda self, frame: grown.append(self.getNumTrees()) or fit(self, frame))
    first = learning.cross_species(df, ["x"], "label", "image_id", trees=7, fit_nodes=60).orderBy("image_id").collect()
    assert sorted(grown) == [1, 1, 2, 2, 2, 2, 2, 2]  # the driver holds two trees of 30 rows for each fit
    assert [r["species"] for r in first] == ["abc"[i % 3] for i in range(60)] and all(0.5 < r["species_conf"] <= 1 for r in first)
    assert first == learning.cross_species(df, ["x"], "label", "image_id", trees=7, fit_nodes=60).orderBy("image_id").collect()


def _planted(count, seed):
    rng = random.Random(seed)
    centre = {"birch": (90, 40), "pine": (60, 70), "spruce": (30, 50)}
    return [(i, kind, *(rng.gauss(c, 9) for c in centre[kind]), rng.random()) for i in range(count) for kind in [rng.choice(sorted(centre))]]


def test_tasks_grow_the_trees_of_more_rows_than_spark_fits(spark, monkeypatch):
    rows = _planted(1500, 6)
    rows[0] = (0, rows[0][1], None, *rows[0][3:])
    rows[1] = (1, rows[1][1], float("nan"), *rows[1][3:])
    rows[2] = (2, None, *rows[2][2:])
    df = learning.group_split(spark.createDataFrame(rows, "image_id bigint, label string, a double, b double, noise double"), "image_id")
    fits = []
    monkeypatch.setattr(learning.RandomForestClassifier, "fit", lambda self, frame: fits.append(self))
    got = []
    for parts in (2, 7):
        scored = learning.cross_species(df.repartition(parts), ["a", "b", "noise"], "label", "image_id", trees=45)
        got.append(sorted(map(tuple, scored.select("image_id", F.coalesce("species", F.lit("")), F.coalesce("species_conf", F.lit(0.0))).collect())))
    assert got[0] == got[1] and len(got[0]) == 1500 and not fits  # Spark grew each of these forests in 180 000 rows' worth of nodes on the driver
    assert got[0][0] == (0, "", 0.0) and got[0][1] == (1, "", 0.0) and got[0][2][1] in ("birch", "pine", "spruce")
    assert all(1 / 3 <= conf <= 1 for _, _, conf in got[0][2:])
    assert sum(species == row[1] for (_, species, _), row in zip(got[0], rows)) >= 0.85 * 1500
    guessed = learning.cross_species(df.drop("label").join(df.select((F.col("image_id") * 7 % 1500).alias("image_id"), "label"), "image_id"),
                                     ["a", "b", "noise"], "label", "image_id", trees=45)
    hits = guessed.join(df.select("image_id", F.expr("label as other")), "image_id").where("species = other").count()
    assert hits <= 0.55 * 1500  # labels that say nothing can't be learned


def test_tasks_and_spark_grow_alike_forests(spark, monkeypatch):
    df = learning.group_split(spark.createDataFrame(_planted(400, 8), "image_id bigint, label string, a double, b double, noise double"), "image_id")
    spark_grown = {r["image_id"]: r for r in learning.cross_species(df, ["a", "b", "noise"], "label", "image_id", trees=60).collect()}
    monkeypatch.setattr(learning, "SPARK_ROWS", 0)
    task_grown = {r["image_id"]: r for r in learning.cross_species(df, ["a", "b", "noise"], "label", "image_id", trees=60).collect()}
    assert len(task_grown) == 400
    assert sum(task_grown[k]["species"] == r["species"] for k, r in spark_grown.items()) >= 0.93 * 400
    assert abs(sum(task_grown[k]["species_conf"] - r["species_conf"] for k, r in spark_grown.items())) <= 0.05 * 400


def test_a_tree_takes_the_split_that_lowers_gini_most():
    rng = np.random.default_rng(9)
    for trial in range(40):
        bins, y = rng.integers(0, rng.choice([3, 12, 200]), size=(60, 4)).astype(np.uint8), rng.integers(0, 3, 60)
        node, count, weight = rng.integers(0, 3, 60), rng.integers(1, 4, 60), np.array([0.7, 1.0, 1.6])
        node[:3] = range(3)
        if trial % 2:  # few nodes for the rows: sums by bin instead of sorted rows
            bins, y, node, count = (np.concatenate([v] * 40) for v in (bins, y, node, count))
        total = np.zeros((3, 3))
        np.add.at(total, (y, node), count)
        figure, limit = forest._best_splits(bins.ravel(), np.arange(len(y)) * 4, node, y, count, total, weight, [np.full(3, f) for f in (2, 0)])

        def purity(some):
            sums = np.bincount(y[some], weights=count[some], minlength=3) * weight
            return (sums ** 2).sum() / sums.sum()

        for n in range(3):
            own = node == n
            best = max([(purity(own & (bins[:, f] <= v)) + purity(own & (bins[:, f] > v)), f) for f in (2, 0) for v in np.unique(bins[own, f])[:-1]], default=(0, -1))
            if figure[n] >= 0:
                side = bins[:, figure[n]] <= limit[n]
                assert abs(purity(own & side) + purity(own & ~side) - best[0]) <= 1e-9 * best[0]
            else:
                assert best[0] <= purity(own) * (1 + 1e-9)


def test_every_segment_is_nearest_to_the_centre_of_its_type(spark):
    rng = random.Random(4)
    rows = [(f"t{i % 2}", i, rng.gauss(i % 4 * 5, 1), rng.gauss(i % 3 * 4, 1)) for i in range(160)] + [("t0", 999, None, 1.0)]
    df = spark.createDataFrame(rows, "tile_id string, seg_id bigint, p double, q double")
    typed = {(r.tile_id, r.seg_id): r.habitat_type for r in learning.habitat_types(df, ["p", "q"], 4).collect()}
    assert typed.pop(("t0", 999)) is None and set(typed.values()) == {1, 2, 3, 4}
    known = [r for r in rows if r[2] is not None]
    spread = [max(1e-9, (sum((r[k] - sum(x[k] for x in known) / len(known)) ** 2 for r in known) / (len(known) - 1)) ** 0.5) for k in (2, 3)]
    point = {r[:2]: (r[2] / spread[0], r[3] / spread[1]) for r in known}
    centre = {}
    for t in range(1, 5):
        own = [point[k] for k, v in typed.items() if v == t]
        centre[t] = tuple(sum(p[d] for p in own) / len(own) for d in (0, 1))
    off = sum(min(centre, key=lambda t: sum((a - b) ** 2 for a, b in zip(p, centre[t]))) != typed[k] for k, p in point.items())
    assert off <= 2  # the search stops within a tolerance


def test_types_do_not_depend_on_the_place_of_rows_and_read_them_once(spark):
    rng = random.Random(5)
    rows = [(f"t{i % 2}", i, rng.random(), rng.random()) for i in range(120)] + [("t0", 999, None, 1.0)]
    seen = spark.sparkContext.accumulator(0)

    def figure(p):
        seen.add(1)
        return p

    got = []
    for parts in (2, 7):
        df = spark.createDataFrame(rows, "tile_id string, seg_id bigint, p double, q double").repartition(parts)
        df = df.withColumn("p", F.udf(figure, "double").asNondeterministic()("p"))
        got.append(sorted(tuple(r) for r in learning.habitat_types(df, ["p", "q"], 4).select("tile_id", "seg_id", F.coalesce("habitat_type", F.lit(0))).collect()))
    assert got[0] == got[1] and len(got[0]) == 121
    assert seen.value == 2 * 121
