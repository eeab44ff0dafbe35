"""Many rows at few places: work follows the places, and sides that unfold are not broadcast unmeasured."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyframe.operators import cameras, provenance, selection
from canopyframe.spatial import range_join
from tests.test_loops import _sequential_match


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_box_addresses_are_not_broadcast(spark):
    pixels = spark.range(64).selectExpr("1L as image_id", "cast(id div 8 as int) as row", "cast(id % 8 as int) as col", "cast(id as int) as r")
    boxes = spark.createDataFrame([(7, 1, 0, 8, 0, 8), (8, 1, 2, 4, 3, 4)], "tree_id long, camera_id long, x0 int, x1 int, y0 int, y1 int")
    got = cameras.box_pixels(boxes, pixels)
    assert "BroadcastHashJoin" not in _plan(got)
    assert {r.tree_id: (r.n, r.s) for r in got.groupBy("tree_id").agg(F.count("r").alias("n"), F.sum("r").alias("s")).collect()} == {7: (64, 2016), 8: (2, 53)}


def test_repeated_side_of_a_distance_join_is_not_broadcast_unmeasured(spark):
    many = spark.range(100).selectExpr("id", "id * 1.0D as x", "0.0D as y")
    few = spark.range(30000).selectExpr("id as k", "id * 0.5D as fx", "0.0D as fy")
    got = range_join(many, few, 0.25, ("x", "y"), ("fx", "fy"))
    assert "BroadcastHashJoin" not in _plan(got)
    assert got.count() == 100


@pytest.mark.parametrize("per_row", [200, 0.01])
def test_stacks_match_like_the_sequential_rule(spark, per_row):
    rng = np.random.default_rng(11)
    spot = lambda n: [(float(x) / 8, float(y) / 8) for x, y in rng.integers(0, 5, (n, 2))]
    refs = [(int(i), *p) for i, p in zip(rng.permutation(60), spot(60))]
    dets = [(int(j), *p) for j, p in zip(rng.permutation(90), spot(90))]
    r = spark.createDataFrame(refs, "ref_id int, ref_x double, ref_y double")
    d = spark.createDataFrame(dets, "det_id int, x double, y double")
    got = [(m.ref_id, m.det_id) for m in selection._match_crowded(r, d, 0.3, steps=3, pairs_per_row=per_row).collect()]
    assert len(got) == len(set(got)) and set(got) == _sequential_match(refs, dets, 0.3)


def test_few_places_need_one_radius(spark, monkeypatch):
    joins = []
    monkeypatch.setattr(selection, "range_join", lambda *a, **k: joins.append(a) or range_join(*a, **k))
    r = spark.range(40).selectExpr("id as ref_id", "(id % 4) * 0.5D as ref_x", "0.0D as ref_y")
    d = spark.range(80).selectExpr("id as det_id", "(id % 4) * 0.5D + 0.1D as x", "0.0D as y")
    assert selection._match_crowded(r, d, 0.6).count() == 40
    assert len(joins) == 1


def test_context_meets_places_once(spark, monkeypatch):
    met = []

    def joined(*a, **k):
        met.append(range_join(*a, **k))
        return met[-1]
    monkeypatch.setattr(provenance, "range_join", joined)
    places = spark.range(30).selectExpr("id as place_id", "if(id % 2 = 0, 0.0D, 50.0D) as x", "0.0D as y")
    elements = spark.range(200).selectExpr("id as pos", "0.5D as ex", "0.0D as ey",
                                           "map(if(id % 2 = 0, 'landuse', 'boundary'), if(id % 2 = 0, 'forest', 'protected_area'), 'name', concat('E', id)) as tags")
    got = {r.place_id: (r.landuse, r.name, r.protected_area) for r in provenance.map_context(places, elements, 1.5).collect()}
    assert got == {i: ("forest", "E0", "E1") if i % 2 == 0 else (None, None, None) for i in range(30)}
    assert met[0].count() == 1


def test_pairs_of_stacked_positions_come_from_position_pairs(spark):
    from canopyframe.operators import selection

    refs = spark.createDataFrame([(i, float(i % 3), 0.0) for i in range(30)], "ref_id bigint, ref_x double, ref_y double")
    dets = spark.createDataFrame([(i, 0.5 * (i % 4), 0.0) for i in range(40)] + [(99, None, 0.0)], "det_id bigint, x double, y double")
    pairs = selection.candidate_pairs(refs, dets, 0.6)
    want = sorted((r, d, abs(r % 3 - 0.5 * (d % 4))) for r in range(30) for d in range(40) if abs(r % 3 - 0.5 * (d % 4)) <= 0.6)
    assert sorted((p.ref_id, p.det_id, p.distance_m) for p in pairs.collect()) == want
    # no distance is computed per pair of rows
    assert "HYPOT" not in pairs._jdf.queryExecution().optimizedPlan().toString().upper()
