"""Results don't depend on group sizes, appends keep rows, tiles stay apart."""

import json
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from canopyframe.operators import ground, sampling, selection, structure
from canopyframe.operators.colour import recolour_segments
from canopyframe.operators.hulls import max_pair_distance
from canopyframe.operators.inventory import PLACES, SINGLE_SCAN, stand_summary, stem_inventory
from canopyframe.operators.learning import habitat_types
from canopyframe.operators.scenes import typed_attributes
from canopyframe.operators.selection import match_within
from canopyframe.operators.structure import zonal_mean
from canopyframe.plans.carriers import carrier
from canopyframe.ranking import percentiles_by
from canopyframe.sources.clouds import register_sources


def test_append_keeps_earlier_parts(spark, tmp_path):
    register_sources(spark)
    points = spark.range(10).select(F.lit("t").alias("tile_id"), F.col("id").alias("point_idx"), *[F.col("id").cast("double").alias(c) for c in "xyz"],
                                    *[F.lit(7).cast("smallint").alias(c) for c in "rgb"])
    folder = str(tmp_path / "cloud")
    for k in (1, 2):
        points.write.format("cloudbin").mode("append").option("layout", "pcb1").save(folder)
        assert spark.read.format("cloudbin").option("layout", "pcb1").load(folder).count() == 10 * k


@pytest.mark.parametrize("limit", [1_000_000, 5])
def test_percentiles_with_infinite_values(spark, limit):
    values = [float(v) for v in range(17)] + [math.inf, math.inf, -math.inf, math.nan]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1e308), ("b", -1e308)] * 4, "k string, v double")
    got = {r["k"]: r for r in percentiles_by(df, ["k"], {"mid": ("v", 0.5), "top": ("v", 1.0), "low": ("v", 0.0)}, limit=limit).collect()}
    assert (got["a"]["mid"], got["a"]["top"], got["a"]["low"]) == (8.5, math.inf, -math.inf)
    assert got["b"]["top"] == 1e308 and got["b"]["low"] == -1e308


def test_suppression_keeps_tiles_apart(spark):
    rows = [("A", "a", 0.0, 50), ("A", "b", 0.3, 99), ("B", "c", 9.0, 99), ("B", "d", 9.2, 50)]
    stems = spark.createDataFrame(rows, "tile_id string, name string, x double, n int").withColumn("y", F.lit(0.0))
    kept = selection.suppress_near(stems, 0.5, [-F.col("n")], ("tile_id",))
    assert sorted(r["name"] for r in kept.collect()) == ["b", "c"]


def test_cap_keeps_rows_without_stratum(spark):
    df = spark.range(100).selectExpr("id as point_idx", "if(id < 5, null, id % 2) as stratum")
    assert sampling.stratified_cap(df, F.col("stratum") == 1, 1000, ["point_idx"]).count() == 100


def test_segments_of_tiles_stay_apart(spark):
    rows = [(t, s, x, 0.0, h + k) for t, h in (("A", 1.0), ("B", 5.0)) for s in (1, 2) for k, x in enumerate((0.1, 0.7, 1.3))]
    points = spark.createDataFrame(rows, "tile_id string, seg_id bigint, x double, y double, hag double")
    got = {(r["tile_id"], r["seg_id"]): r["h_max"] for r in structure.segment_structure(points).collect()}
    assert got == {("A", 1): 3.0, ("A", 2): 3.0, ("B", 1): 7.0, ("B", 2): 7.0}


def test_segment_ids_above_16_bit(spark):
    points = spark.createDataFrame([("t", 0.1, 0.1)], "tile_id string, x double, y double")
    cells = spark.createDataFrame([("t", 0, 0, 70_000)], "tile_id string, ix bigint, iy bigint, hedge_id bigint")
    assert [r["seg_id"] for r in structure.point_segments(points, cells).collect()] == [70_000]


def test_matches_stay_inside_their_plot(spark):
    refs = spark.createDataFrame([(p, i, float(i), 0.0) for p in ("a", "b") for i in range(30)], "plot string, ref_id bigint, ref_x double, ref_y double")
    dets = spark.createDataFrame([("a", i, i + 0.1, 0.0) for i in range(30)] + [("b", i, i + 0.2, 0.0) for i in range(5)] + [("c", 1, 1.0, 0.0)],
                                 "plot string, det_id bigint, x double, y double")
    for load in (1e9, 0.0):  # all pairs at once, and growing radii
        got = {(m.plot, m.ref_id, m.det_id, round(m.distance_m, 6)) for m in match_within(refs, dets, 0.5, load, on=["plot"]).collect()}
        assert got == {("a", i, i, 0.1) for i in range(30)} | {("b", i, i, 0.2) for i in range(5)}


def test_segments_of_two_tiles_keep_their_own_values(spark):
    points = spark.createDataFrame([(t, 1, 10, 10, 10) for t in ("a", "b")], "tile_id string, seg_id bigint, r int, g int, b int")
    values = spark.createDataFrame([("a", 1, 0.0), ("b", 1, 1.0)], "tile_id string, seg_id bigint, value double")
    got = {r.tile_id: (r.r, r.g, r.b) for r in recolour_segments(points, values).collect()}
    assert len(got) == 2 and got["a"] != got["b"] and recolour_segments(points, values).count() == 2
    rows = [(t, i, float(i % 2), float(i % 3)) for t in ("a", "b") for i in range(8)] + [("a", 99, None, 1.0)]
    typed = habitat_types(spark.createDataFrame(rows, "tile_id string, seg_id bigint, p double, q double"), ["p", "q"], 2)
    assert sorted((r.tile_id, r.seg_id) for r in typed.collect()) == sorted(r[:2] for r in rows)


def test_zonal_mean_weighs_shared_area(spark):
    zones = spark.createDataFrame([(t, x, y, 1 if x < 3 else 2) for t in ("a", "b") for x in range(5) for y in range(4)] + [("a", 500, 500, 3)],
                                  "tile_id string, ix bigint, iy bigint, seg_id bigint")
    cells = [(t, x, y, None if (x, y) == (1, 1) else (x * 10.0 + y) * (1 if t == "a" else -1)) for t in ("a", "b") for x in range(-3, 6) for y in range(-3, 6)]
    raster = spark.createDataFrame(cells, "tile_id string, ix bigint, iy bigint, value double")
    for size, cell, origin in ((0.5, 0.7, (-0.3, 0.1)), (1.0, 0.3, (0.05, -0.2)), (0.5, 0.5, (0.0, 0.0))):
        got = {(r.tile_id, r.seg_id): (r.ndvi, r.covered) for r in zonal_mean(zones, raster, "ndvi", size, cell, origin).collect()}
        assert got.pop(("a", 3)) == (None, 0.0)
        for (t, s), (mean, covered) in got.items():
            total = weight = area = 0.0
            for x in range(5):
                for y in range(4):
                    if (1 if x < 3 else 2) == s:
                        area += size * size
                        for tile, i, j, v in cells:
                            w = max(0.0, min((x + 1) * size, origin[0] + (i + 1) * cell) - max(x * size, origin[0] + i * cell))
                            h = max(0.0, min((y + 1) * size, origin[1] + (j + 1) * cell) - max(y * size, origin[1] + j * cell))
                            if tile == t and v is not None:
                                total, weight = total + w * h * v, weight + w * h
            assert abs(covered - weight / area) < 1e-9 and (mean is None if not weight else abs(mean - total / weight) < 1e-9)


def test_attributes_keep_their_kind(spark):
    row = spark.createDataFrame([({"n": "12.50", "t": 'a "b"\n', "inf": "inf", "nan": "nan", "none": "", "e": "1e3"},)], "a map<string,string>")
    got = json.loads(row.select(F.to_json(F.struct(typed_attributes(F.col("a")).alias("a")))).first()[0])["a"]
    assert got == {"n": 12.5, "t": 'a "b"\n', "inf": "inf", "nan": "nan", "e": 1000.0}


def test_attributes_become_variants_without_json_text(spark):
    df = spark.createDataFrame([({'k "1"': "-.5", "big": "1e400", "z": "24.0"},), ({},), (None,)], "a map<string,string>")
    typed = df.select(typed_attributes(F.col("a")).alias("a"))
    got = [r[0] and json.loads(r[0]) for r in typed.select(F.to_json("a")).collect()]
    assert got == [{'k "1"': -0.5, "big": "1e400", "z": 24.0}, {}, None]
    assert "json" not in typed._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize("pack", [256, 3])
def test_nearest_stem_in_crowds(spark, pack):
    rng = random.Random(5)
    stems = [(t, i, round(rng.gauss(5, 1 if i % 2 else 6), 2), round(rng.gauss(5, 1 if i % 2 else 6), 2), rng.uniform(0.5, 5)) for t in ("a", "b") for i in range(40)]
    stems += [("a", 900 + i, 5.0, 5.0, 1.0) for i in range(8)]  # at one place: ties go to the lowest
    points = [(t, i, round(rng.uniform(-8, 18), 2), round(rng.uniform(-8, 18), 2), 1.0, rng.choice([0.2, 0.4, 0.5, 3.0])) for t in ("a", "b", "c") for i in range(300)]
    got = ground.nearest_stem(spark.createDataFrame(points, "tile_id string, point_idx bigint, x double, y double, z double, hag double"),
                              spark.createDataFrame(stems, "tile_id string, stem_id bigint, x double, y double, crown_radius_m double"), pack=pack).collect()
    want = {}
    for t, i, x, y, _, hag in points:
        best = min(((math.hypot(x - sx, y - sy), s, c) for tile, s, sx, sy, c in stems if tile == t), default=None)
        want[(t, i)] = best[1] if hag > 0.4 and best and best[0] <= min(best[2], 4.0) else None
    assert {(r.tile_id, r.point_idx): r.label for r in got} == want and len(got) == 900


def test_farthest_pair_of_awkward_groups(spark):
    rng = random.Random(7)
    groups = {"cloud": [(rng.gauss(0, 5), rng.gauss(9, 1)) for _ in range(800)], "circle": [(1e4 + math.cos(i / 50 * math.pi), math.sin(i / 50 * math.pi)) for i in range(101)],
              "line": [(i * 0.1, i * 0.3) for i in range(60)], "one": [(3.0, 4.0)] * 5, "two": [(0.0, 0.0), (0.0, 1e-9)], "square": [(i % 10, i // 10) for i in range(100)],
              "far": [(1e7 + rng.random(), -1e7 + rng.random()) for _ in range(200)], "none": [(None, 1.0), (math.nan, 2.0), (math.inf, 0.0)]}
    rows = [(g, x, y) for g, places in groups.items() for x, y in [(None if x is None else float(x), float(y)) for x, y in places]]
    got = {r.g: r.span_m for r in max_pair_distance(spark.createDataFrame(rows, "g string, x double, y double"), ["g"]).collect()}
    assert got.pop("none") is None and got.keys() == groups.keys() - {"none"}
    for g, span in got.items():
        assert span == pytest.approx(max(math.hypot(a[0] - b[0], a[1] - b[1]) for a in groups[g] for b in groups[g]), rel=1e-12)


def test_published_values_are_rounded(spark, sf_dir):
    points = carrier(spark, sf_dir, "points")
    plain = stem_inventory(points, SINGLE_SCAN).collect()
    got = stem_inventory(points, replace(SINGLE_SCAN, rounded=True))
    rows = {r.label: r for r in got.collect()}
    assert len(rows) == len(plain) == 10
    for r in plain:
        near = min(rows.values(), key=lambda o: math.hypot(o.x - r.x, o.y - r.y))
        for name, digits in PLACES.items():
            value = getattr(near, name)
            assert value is None or (value == round(value, digits) and abs(value - getattr(r, name)) <= 0.5001 * 10 ** -digits)
    stand = stand_summary(got.withColumn("stand", F.lit(1)), 0.25, ["stand"]).first()
    assert stand.basal_area_m2 == pytest.approx(sum(r.basal_area_m2 for r in rows.values()), abs=1e-12)


def test_default_ground_does_not_move_the_points(spark):
    from canopyframe.operators.ground import ground_model, normalize_height
    pts = spark.range(400).selectExpr("concat('t', id % 2) as tile_id", "id as point_idx", "id % 7 / 2 as x", "id % 5 / 2 as y", "id % 11 / 10 as z").localCheckpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the points were too many
    try:
        out = normalize_height(pts, ground_model(pts, 2.0, 0.05, 5), 2.0, default_ground=True)
        # one tile's points would otherwise go to as many tasks as there are salts
        assert out._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out.count() == 400 and out.where("hag is null").count() == 0


def test_band_above_moves_only_points_near_the_band(spark):
    rows = [(t, i, 0.1 * (i % 50), 0.0, round((i % 50) * 0.02 + (i * 7 % 90) / 10, 4)) for t in ("a", "b") for i in range(3000)] + [("c", 1, 0.0, 0.0, 1.2)]
    pts = spark.createDataFrame(rows, "tile_id string, point_idx bigint, x double, y double, z double")
    model = ground.ground_model(pts).localCheckpoint()
    want = ground.height_band(ground.normalize_height(pts, model), 1.0, 1.6)
    got = ground.band_above(pts, model, 1.0, 1.6)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_low" in plan and "_high" in plan
