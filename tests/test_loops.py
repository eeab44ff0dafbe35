"""Parallel rounds against their sequential definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyframe.operators import components, ground, hulls, selection, singletree
from canopyframe.runtime import salted_join
from canopyframe.spatial import range_join


def _sequential_keep(rows, dist):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        if all(math.hypot(r[1] - k[1], r[2] - k[2]) >= dist for k in kept):
            kept.append(r)
    return {k[0] for k in kept}


@pytest.mark.parametrize("seed,spread", [(1, 6.0), (2, 1.0), (3, 0.0)])
def test_suppression_equals_sequential(spark, seed, spread):
    rng = np.random.default_rng(seed)
    xy = rng.uniform(0, spread, (250, 2)) if spread else np.zeros((250, 2))
    rows = [(i, float(x), float(y), int(n)) for i, ((x, y), n) in enumerate(zip(xy, rng.integers(0, 30, 250)))]
    df = spark.createDataFrame(rows, "id int, x double, y double, n int")
    got = selection.suppress_near(df, 0.6, [-F.col("n"), F.col("id")])
    assert {r.id for r in got.collect()} == _sequential_keep(rows, 0.6)


def _sequential_match(refs, dets, max_dist):
    pairs = sorted((math.hypot(a - x, b - y), i, j) for i, a, b in refs for j, x, y in dets if math.hypot(a - x, b - y) <= max_dist)
    used_r, used_d, want = set(), set(), set()
    for _, i, j in pairs:
        if i not in used_r and j not in used_d:
            used_r.add(i), used_d.add(j), want.add((i, j))
    return want


def test_matching_equals_sequential(spark):
    rng = np.random.default_rng(4)
    refs = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 1.2, (40, 2)))]
    dets = [(j, float(x), float(y)) for j, (x, y) in enumerate(rng.uniform(0, 1.2, (60, 2)))]
    r = spark.createDataFrame(refs, "ref_id int, ref_x double, ref_y double")
    d = spark.createDataFrame(dets, "det_id int, x double, y double")
    got = {(m.ref_id, m.det_id) for m in selection.match_within(r, d, 0.5).collect()}
    assert got == _sequential_match(refs, dets, 0.5)


def test_crowded_matching_equals_sequential(spark):
    """Stacks of copies, some exactly as close to a place as others."""
    spots_r = [(0.0, 0.0)] * 9 + [(0.25, 0.0)] * 2 + [(3.0, 0.0)]
    spots_d = [(0.125, 0.0)] * 3 + [(0.0, 0.0)] * 5 + [(3.1, 0.0)] * 4
    refs = [(i, x, y) for i, (x, y) in zip([5, 1, 9, 0, 7, 2, 11, 3, 8, 4, 10, 6], spots_r)]
    dets = [(j, x, y) for j, (x, y) in enumerate(spots_d)]
    r = spark.createDataFrame(refs, "ref_id int, ref_x double, ref_y double")
    d = spark.createDataFrame(dets, "det_id int, x double, y double")
    got = {(m.ref_id, m.det_id) for m in selection._match_crowded(r, d, 0.5, steps=2).collect()}
    assert got == _sequential_match(refs, dets, 0.5)


def _flood(cells, steps):
    seen, label = set(), {}
    for start in sorted(cells):
        if start in seen:
            continue
        stack = [start]
        seen.add(start)
        while stack:
            c = stack.pop()
            label[c] = start
            for dx, dy in steps:
                n = (c[0] + dx, c[1] + dy)
                if n in cells and n not in seen:
                    seen.add(n)
                    stack.append(n)
    return label


@pytest.mark.parametrize("neighbours", [4, 8])
def test_components_equal_flood_fill_across_blocks(spark, neighbours, monkeypatch):
    monkeypatch.setattr(components, "BLOCK", 8)
    rng = np.random.default_rng(9)
    cells = {(int(x), int(y)) for x, y in rng.integers(-30, 30, (1900, 2))}
    steps = [(0, 1), (0, -1), (1, 0), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if neighbours == 8 else [])
    df = spark.createDataFrame([("t", x, y) for x, y in sorted(cells)], "tile_id string, ix bigint, iy bigint")
    got = {(r.ix, r.iy): (r.comp_x, r.comp_y) for r in components.connected_components(df, neighbours).collect()}
    assert got == _flood(cells, steps)


def test_components_keep_tiles_apart(spark):
    df = spark.createDataFrame([("a", 0, 0), ("b", 0, 1)], "tile_id string, ix bigint, iy bigint")
    got = {(r.tile_id, r.comp_x, r.comp_y) for r in components.connected_components(df).collect()}
    assert got == {("a", 0, 0), ("b", 0, 1)}


def test_long_snake_is_one_component(spark, monkeypatch):
    monkeypatch.setattr(components, "BLOCK", 4)
    cells = [("t", x, (x // 2) % 2) for x in range(120)]
    df = spark.createDataFrame(cells, "tile_id string, ix bigint, iy bigint")
    got = {(r.comp_x, r.comp_y) for r in components.connected_components(df).collect()}
    assert got == {(0, 0)}


def test_range_join_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b = rng.uniform(-5, 5, (300, 2)), rng.uniform(-5, 5, (50, 2))
    many = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "i int, x double, y double")
    few = spark.createDataFrame([(j, float(x), float(y)) for j, (x, y) in enumerate(b)], "j int, u double, v double")
    want = {(i, j) for i in range(300) for j in range(50) if math.hypot(*(a[i] - b[j])) <= 0.7}
    for salts in (1, 5):
        got = range_join(many, few, 0.7, ("x", "y"), ("u", "v"), salts=salts)
        assert {(r.i, r.j) for r in got.collect()} == want


def test_nearest_stem_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    pts, stems = rng.uniform(0, 20, (400, 2)), rng.uniform(0, 20, (15, 2))
    crowns = rng.uniform(1.5, 4, 15)
    p = spark.createDataFrame([("t", i, float(x), float(y), 1.0, float(i % 3)) for i, (x, y) in enumerate(pts)],
                              "tile_id string, point_idx int, x double, y double, z double, hag double")
    s = spark.createDataFrame([("t", j, float(x), float(y), float(crowns[j])) for j, (x, y) in enumerate(stems)],
                              "tile_id string, stem_id int, x double, y double, crown_radius_m double")
    got = {r.point_idx: r.label for r in ground.nearest_stem(p, s, 3.0).collect()}
    for i in range(400):
        d = np.hypot(*(stems - pts[i]).T)
        j = int(d.argmin())
        assert got[i] == (j if i % 3 > 0.4 and d[j] <= min(crowns[j], 3.0) else None)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    big = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(300)], "k int, i int")
    small = spark.createDataFrame([(k, k * 10) for k in range(4)], "k int, w int")
    want = sorted(map(tuple, big.join(small, "k", how).collect()), key=str)
    assert sorted(map(tuple, salted_join(big, small, ["k"], how, 6).collect()), key=str) == want


def test_span_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    xy = rng.normal(0, 9, (500, 2))
    df = spark.createDataFrame([("a" if i else "single", float(x), float(y)) for i, (x, y) in enumerate(xy)], "k string, x double, y double")
    got = {r.k: r.span_m for r in hulls.max_pair_distance(df, ["k"]).collect()}
    want = max(math.hypot(*(p - q)) for p in xy[1:] for q in xy[1:])
    assert got["single"] == 0.0 and got["a"] == pytest.approx(want)


def test_gated_fit_ignores_the_neighbour_stem(spark):
    rng = np.random.default_rng(5)
    ang = rng.uniform(0, 2 * np.pi, 300)
    stem = np.c_[5.4e6 + 0.2 * np.cos(ang[:200]), 4.1e5 + 0.2 * np.sin(ang[:200])]
    other = np.c_[5.4e6 + 0.7 + 0.1 * np.cos(ang[200:260]), 4.1e5 + 0.1 * np.sin(ang[200:260])]
    df = spark.createDataFrame([(1, float(x), float(y)) for x, y in np.r_[stem, other]], "label int, x double, y double")
    r = singletree.gated_fit(df).first()
    assert r.radius_m == pytest.approx(0.2, abs=1e-3) and r.arc_deg == 340 and r.fit_rms_m < 1e-3
