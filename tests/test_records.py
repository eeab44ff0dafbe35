"""Behaviour that the oracles do not cover."""

import json

import pytest
from pyspark.sql import functions as F

from canopyframe.operators import growth, inventory, provenance, scenes, statistics
from canopyframe.spatial import range_join


def test_projection_of_a_tall_and_a_thin_tree(spark):
    trees = spark.createDataFrame([("t1", 511, 50.0, 25.0), ("t2", 511, 8.0, 6.0)],
                                  "tree_id string, species_code int, dbh_cm double, height_m double")
    rows = growth.project_growth(trees, 20, 5, 2024).orderBy("year", "tree_id").collect()
    years = sorted({r.year for r in rows})
    assert years == [2024, 2029, 2034, 2039, 2044] and len(rows) == 10
    last = {r.tree_id: r for r in rows if r.year == 2044}
    assert last["t1"].dbh_cm == pytest.approx(58.0) and last["t1"].height_m == pytest.approx(30.0) and last["t1"].alive
    assert last["t2"].removed and not [r for r in rows if r.tree_id == "t2" and r.year < 2039 and r.removed]


def test_histogram_keeps_the_value_between_edges(spark):
    trees = spark.createDataFrame([(1, v) for v in (80.5, 10.0, 9.99, 80.0)] + [(2, 20.0)], "stand_id int, dbh_cm double")
    rows = {(r.stand_id, r.lower_cm): r.n_stems for r in inventory.dbh_histogram(trees, ["stand_id"]).collect()}
    assert rows[(1, 80)] == 2 and rows[(1, 0)] == 1 and rows[(1, 10)] == 1 and rows[(1, 50)] == 0
    assert rows == {**rows, (2, 10): 1} and (2, 20) not in rows


def test_numbers_are_read_like_plain_decimals(spark):
    texts = ["1.5", " 2 ", "", "5d", "1_000", "abc", "-.5e2", "+3."]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(statistics.numeric(F.col("t")).alias("v"))
    assert [r.v for r in df.collect()] == [1.5, 2.0, None, None, None, None, -50.0, 3.0]


def test_saved_responses_become_rows(spark):
    soil = {"properties": {"layers": [{"name": "phh2o", "unit_measure": {"d_factor": 10, "target_units": "pH"}, "depths": [{"values": {"mean": 57}}]},
                                      {"name": "clay", "unit_measure": {}, "depths": [{"values": {"mean": None}}]}]}}
    df = spark.createDataFrame([(1, json.dumps(soil)), (2, None)], "place_id int, body string")
    assert {(r.property, r.value, r.units) for r in provenance.soil_layers(df).collect()} == {("phh2o", 5.7, "pH"), ("clay", None, "")}
    elev = spark.createDataFrame([(1, '{"results": [{"elevation": 12.0}, {"elevation": 14}]}')], "place_id int, body string")
    assert [tuple(r) for r in provenance.elevation_points(elev).orderBy("pos").collect()] == [(1, 0, 12.0), (1, 1, 14.0)]
    osm = spark.createDataFrame([(1, '{"elements": [{"center": {"lat": 1.0, "lon": 2.0}, "tags": {"landuse": "forest"}}]}')], "place_id int, body string")
    r = provenance.map_elements(osm).first()
    assert (r.lat, r.lon, r.tags) == (1.0, 2.0, {"landuse": "forest"})


def test_manifest_takes_the_first_level_and_splits_long_marker_lists(spark, monkeypatch):
    scene = spark.createDataFrame([("a", "A", None, None, None, None, "e57", None, None)],
                                  "id string, title string, created timestamp, pano string, thumb string, video string, source_type string, gps_lat double, gps_lon double")
    markers = spark.range(5).select(F.lit("a").alias("id"), F.col("id").alias("pos"), F.format_string("m%d", "id").alias("label"))
    levels = spark.createDataFrame([("a", 2, "full", "f.bin", 9), ("a", 1, "lite", "l.bin", 3)], "id string, level_no int, level string, bin string, count int")
    doc = json.loads(scenes.scene_manifest(scene, markers, levels).first().manifest)
    assert doc["pointcloud"]["bin"] == "l.bin" and [lv["level"] for lv in doc["pointcloud"]["levels"]] == ["lite", "full"]
    assert doc["pano"] is None and [m["label"] for m in doc["markers"]] == ["m0", "m1", "m2", "m3", "m4"]
    parts = scenes.marker_documents(markers, ["id"], part_rows=2)
    assert parts.count() == 3
    back = scenes.explode_markers(parts, part_rows=2).orderBy("pos").collect()
    assert [(r.pos, r.label) for r in back] == [(k, f"m{k}") for k in range(5)]


def test_slugs_and_deletes(spark):
    df = spark.createDataFrame([("plot-1",), ("",), ("Upper",), ("-x",), ("a" * 65,), (None,)], "id string")
    assert [r.ok for r in df.select(scenes.valid_slug(F.col("id")).alias("ok")).collect()] == [True] + [False] * 5
    left, bad = scenes.delete_scenes(df.where("id in ('plot-1', '-x')"), df.where("id is not null"))
    assert [r.id for r in left.collect()] == ["-x"]
    assert {r.id for r in bad.collect()} == {"", "Upper", "-x", "a" * 65}


def test_distance_join_is_an_equi_join(spark):
    a = spark.range(1000).selectExpr("id", "id / 7.0D as x", "id / 9.0D as y")
    b = spark.range(50).selectExpr("id as j", "id / 3.0D as u", "id / 5.0D as v")
    plan = range_join(a, b, 1.0, ("x", "y"), ("u", "v"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_habitat_types_keep_every_segment(spark):
    from canopyframe.operators.learning import habitat_types
    rows = [(i, float(i % 2) * 10 + i / 100, 1.0 + i) for i in range(8)] + [(8, None, 1.0), (9, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "seg_id int, a double, b double")
    got = {r["seg_id"]: r["habitat_type"] for r in habitat_types(df, ["a", "b"], k=2).collect()}
    assert sorted(got) == list(range(10)) and got[8] is None and got[9] is None and all(got[i] in (1, 2) for i in range(8))
    few = habitat_types(df.where("seg_id > 6"), ["a", "b"], k=2).collect()
    assert len(few) == 3 and all(r["habitat_type"] is None for r in few)


def test_species_of_every_fold(spark):
    from canopyframe.operators.learning import cross_species
    rows = [(i, i % 4, float(i % 3), "abc"[i % 3]) for i in range(24)]
    df = spark.createDataFrame(rows, "image_id int, fold int, x double, label string")
    got = {r["image_id"]: r["species"] for r in cross_species(df, ["x"], "label", "image_id", trees=5).collect()}
    assert got == {i: "abc"[i % 3] for i in range(24)}


def test_splats_keep_the_point(spark):
    from canopyframe.operators.cylinders import points_to_splats
    got = points_to_splats(spark.createDataFrame([(7, 1.0, 2.0, 3.0, 0, 255, 128)], "point_idx int, x double, y double, z double, r int, g int, b int"), keep=("point_idx",))
    assert got.first()["point_idx"] == 7 and got.columns[:4] == ["point_idx", "x", "y", "z"]
