"""Visibility against a plain projection of every point into every camera."""

import random

import numpy as np
import pytest

from canopyframe.operators import cameras as cam

POINTS = "point_idx bigint, x double, y double, z double"
CAMERAS = ("camera_id bigint, qw double, qx double, qy double, qz double, tx double, ty double, tz double, fx double, fy double, "
           "cx double, cy double, width int, height int")


def _scene(n, seed, flat=False):
    rng = random.Random(seed)
    points = [(i, rng.uniform(-40, 40), rng.uniform(-40, 40), rng.uniform(0, 0.2 if flat else 25)) for i in range(n)]
    views = []
    for i in range(12):
        q = np.array([rng.gauss(0, 1) for _ in range(4)])
        views.append((i, *(float(v) for v in q / np.linalg.norm(q)), rng.uniform(-45, 45), rng.uniform(-45, 45), rng.uniform(0, 20),
                      300.0, 340.0, 150.0, 130.0, 320, 240))
    return points, views


def _plain(points, views, min_depth, margin):
    out = {}
    xyz = np.array([p[1:] for p in points])
    for v in views:
        w, x, y, z = v[1:5]
        r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
                      [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
        c = (xyz - np.array(v[5:8])) @ r * np.array([1, -1, -1])
        for p, (a, b, d) in zip(points, c):
            if d > min_depth:
                u, t = v[8] * a / d + v[10], v[9] * b / d + v[11]
                if margin <= u < v[12] - margin and margin <= t < v[13] - margin:
                    out[(v[0], p[0])] = (u, t, d)
    return out


@pytest.mark.parametrize("n, flat, min_depth, margin", [(4000, False, 1e-3, 0.0), (3000, True, 0.5, 40.0), (1, False, 1e-3, 0.0)])
def test_visible_equals_plain_projection(spark, n, flat, min_depth, margin):
    points, views = _scene(n, n, flat)
    posed = cam.pose_to_extrinsics(spark.createDataFrame(views, CAMERAS))
    rows = points + [(10**6, float("nan"), 0.0, 0.0), (10**6 + 1, None, 0.0, 0.0)]
    got = {(r.camera_id, r.point_idx): (r.u, r.v, r.depth) for r in cam.visible(spark.createDataFrame(rows, POINTS), posed, min_depth, margin).collect()}
    want = _plain(points, views, min_depth, margin)
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-6) for k in want)


def test_visible_of_nothing(spark):
    points, views = _scene(3, 1)
    posed = cam.pose_to_extrinsics(spark.createDataFrame(views, CAMERAS))
    assert cam.visible(spark.createDataFrame([], POINTS), posed).count() == 0
    assert cam.visible(spark.createDataFrame(points, POINTS), posed.where("camera_id < 0")).count() == 0


def test_joined_rows_follow_seen_rows(spark):
    points, views = _scene(60_000, 7)
    narrow = [(*v[:8], 1500.0, 1500.0, *v[10:]) for v in views]  # sees a small part of the scene
    posed = cam.pose_to_extrinsics(spark.createDataFrame(narrow, CAMERAS))
    keyed, reached = cam.cells_in_view(spark.createDataFrame(points, POINTS), posed)
    joined = keyed.join(reached, ["_gx", "_gy", "_gz"]).count()
    seen = len(_plain(points, narrow, 1e-3, 0.0))
    assert 0 < seen and joined <= 8 * seen < len(points) * len(views) / 8
