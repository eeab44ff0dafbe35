"""Camera poses: projection, best view, panorama resampling and rendering."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.functions import geometry
from canopyframe.operators import rasters
from canopyframe.runtime import BROADCAST_LIMIT, broadcast_if_small, cut_lineage, salted_join

#: Points that a cell of the visibility hierarchy holds on average.
CELL_POINTS = 64
#: Levels of the hierarchy at most; each halves the cells along the three axes.
DEPTH = 16


def pose_to_extrinsics(cameras: DataFrame) -> DataFrame:
    """World-to-camera quaternion and translation of scanner poses ``qw..qz, tx..tz``."""
    q = [F.col(c) for c in ("qw", "qx", "qy", "qz")]
    rot, t = geometry.world_to_camera(q, [F.col(c) for c in ("tx", "ty", "tz")])
    names = ("ew", "ex", "ey", "ez")
    return cameras.withColumns({**dict(zip(names, geometry.quaternion(rot))),
                                **{n: v for n, v in zip(("px", "py", "pz"), t)}})


def _camera_view(point: list[Column]):
    rot = geometry.rotation(*[F.col(c) for c in ("ew", "ex", "ey", "ez")])
    return geometry.project(rot, [F.col(c) for c in ("px", "py", "pz")], point, F.col("fx"), F.col("fy"),
                            F.col("cx"), F.col("cy"))


def visible(points: DataFrame, cameras: DataFrame, min_depth: float = 1e-3, margin: float = 0.0) -> DataFrame:
    """Projections of points into the cameras that see them: adds ``u, v, depth``.

    ``cameras`` has extrinsics, ``fx, fy, cx, cy, width, height``. Cameras descend a
    hierarchy of the occupied cells and leave a cell whose box lies beyond a plane
    of their frustum, so they meet the points of cells that the frustum reaches only.
    Points without finite coordinates are seen by none.
    """
    keyed, reached = cells_in_view(points, cameras, min_depth, margin)
    joined = salted_join(keyed, reached, ["_gx", "_gy", "_gz"])
    u, v, z = _camera_view([F.col(a) for a in "xyz"])
    out = joined.withColumns({"u": u, "v": v, "depth": z}).drop("_gx", "_gy", "_gz")
    return out.where((F.col("depth") > min_depth) & (F.col("u") >= margin) & (F.col("u") < F.col("width") - margin)
                     & (F.col("v") >= margin) & (F.col("v") < F.col("height") - margin))


def cells_in_view(points: DataFrame, cameras: DataFrame, min_depth: float = 1e-3, margin: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The points with their cell ``_gx, _gy, _gz``, and each camera with the cells that its frustum reaches.

    A cell carries the bounds of its points, on every level. The number of levels
    follows the number of points. A level has at most eight times the cells of the one above
    it, so the upper levels are small enough to go to every task; cells that are empty don't exist.
    """
    ends = points.where(_finite_point()).agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{n}{a}") for a in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    cells = max(1.0, (ends["n"] or 0) / CELL_POINTS)
    side = max([1e-9, *((ends[f"hi{a}"] - ends[f"lo{a}"]) for a in "xyz" if ends["n"])])
    # flat clouds fill fewer cells than cubes do, so levels are counted as if for a surface
    levels = min(DEPTH, math.ceil(math.log(cells, 4)))
    step = side / (1 << levels)
    index = {f"_g{a}": F.least(F.floor((F.col(a) - (ends[f"lo{a}"] or 0.0)) / step), F.lit((1 << levels) - 1)).cast("int") for a in "xyz"}
    keyed = points.where(_finite_point()).withColumns(index)
    bounds = [f"_{n}{a}" for a in "xyz" for n in ("lo", "hi")]
    level = cut_lineage(keyed.groupBy(*index).agg(*[f(a).alias(f"_{n}{a}") for a in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))]))
    tree = [level]
    for _ in range(levels):
        level = level.withColumns({g: F.shiftright(g, 1) for g in index}).groupBy(*index).agg(
            *[(F.min if b[1:3] == "lo" else F.max)(b).alias(b) for b in bounds])
        tree.append(level)
    # one row per camera; cut so that no later filter repeats the pose formulas
    rot = geometry.rotation(*[F.col(c) for c in ("ew", "ex", "ey", "ez")])
    posed = cameras.withColumns({f"_r{i}{k}": rot[i][k] for i in range(3) for k in range(3)})
    posed = cut_lineage(posed.withColumn("_planes", _frustum_planes(min_depth, margin)).drop(*[f"_r{i}{k}" for i in range(3) for k in range(3)]))
    reached = posed.withColumns({g: F.lit(0).cast("int") for g in index})
    parents = [f"{g}p" for g in index]
    for depth, level in enumerate(reversed(tree)):
        down = level.withColumns({p: F.shiftright(g, 1) if depth else F.col(g) for p, g in zip(parents, index)})
        above = reached.withColumnsRenamed(dict(zip(index, parents)))
        small = 8 ** depth <= BROADCAST_LIMIT
        reached = above.join(F.broadcast(down), parents) if small else salted_join(above, down, parents)
        reached = reached.where(_reaches_frustum()).drop(*bounds, *parents)
    return keyed, reached.drop("_planes")


def _finite_point() -> Column:
    limit = F.lit(float("inf"))
    checks = [F.abs(F.col(a)) < limit for a in "xyz"]
    return checks[0] & checks[1] & checks[2]


def _frustum_planes(min_depth: float, margin: float) -> Column:
    """The planes around what a camera sees: a point inside has ``x, y, z`` times its place plus ``d`` of at least ``limit``."""
    rot = [[F.col(f"_r{i}{k}") for k in range(3)] for i in range(3)]
    t = [F.col(c) for c in ("px", "py", "pz")]
    left, top = F.col("cx") - margin, F.col("cy") - margin
    right, bottom = F.col("width") - margin - F.col("cx"), F.col("height") - margin - F.col("cy")
    none = F.lit(0.0)
    weights = [(none, none, F.lit(1.0), min_depth), (F.col("fx"), none, left, 0.0), (-F.col("fx"), none, right, 0.0),
               (none, F.col("fy"), top, 0.0), (none, -F.col("fy"), bottom, 0.0)]
    planes = []
    for w in weights:
        dot = lambda v: w[0] * v[0] + w[1] * v[1] + w[2] * v[2]  # noqa: E731, B023
        planes.append(F.struct(*[dot([rot[i][k] for i in range(3)]).alias(n) for k, n in enumerate("xyz")], dot(t).alias("d"),
                               (F.abs(w[0] * t[0]) + F.abs(w[1] * t[1]) + F.abs(w[2] * t[2])).alias("size"), F.lit(float(w[3])).alias("limit")))
    return F.array(*planes)


def _reaches_frustum() -> Column:
    """If the box ``_lox.._hiz`` isn't wholly beyond one of the camera's planes; rounding never loses a box."""
    def inside(p: Column) -> Column:
        low, high = ([p[a] * F.col(f"_{n}{a}") for a in "xyz"] for n in ("lo", "hi"))
        most = sum((F.greatest(x, y) for x, y in zip(low, high)), p["d"])
        size = sum((F.greatest(F.abs(x), F.abs(y)) for x, y in zip(low, high)), p["size"])
        return most + size * 1e-9 >= p["limit"]

    return F.forall("_planes", inside)


def best_view(trees: DataFrame, cameras: DataFrame, key: str = "tree_id", margin: float = 40.0,
              min_depth: float = 0.5) -> DataFrame:
    """Nearest camera that shows the tree well inside its frame; ties go to the lowest camera."""
    seen = visible(trees, cameras, min_depth, margin)
    best = seen.groupBy(key).agg(F.min(F.struct("depth", "camera_id", "u", "v")).alias("b"))
    return best.select(key, "b.camera_id", "b.depth", "b.u", "b.v")


def bark_boxes(views: DataFrame, width: int, height: int, fx: Column) -> DataFrame:
    """Pixel box around the stem in its best view, sized by the stem diameter; tiny boxes are dropped.

    Needs ``u, v, depth, dbh_cm``. Output box is half-open: ``x0, x1, y0, y1``.
    """
    stem_px = fx * (F.col("dbh_cm") / 100.0) / F.col("depth")
    hw = F.greatest(F.floor(stem_px * 0.40), F.lit(4))
    hh = F.greatest(F.floor(stem_px * 1.4), F.lit(10))
    u, v = F.floor("u"), F.floor("v")
    out = views.withColumns({"x0": F.greatest(u - hw, F.lit(0)), "x1": F.least(u + hw, F.lit(width)),
                             "y0": F.greatest(v - hh, F.lit(0)), "y1": F.least(v + hh, F.lit(height))})
    return out.where((F.col("x1") - F.col("x0") >= 6) & (F.col("y1") - F.col("y0") >= 12))


def box_pixels(boxes: DataFrame, pixels: DataFrame, key: str = "tree_id") -> DataFrame:
    """Pixels inside each box: every box lists its pixel addresses, which then meet the image."""
    cells = (boxes.withColumn("row", F.explode(F.sequence("y0", F.col("y1") - 1)))
             .withColumn("col", F.explode(F.sequence("x0", F.col("x1") - 1))))
    cells = cells.select(key, F.col("camera_id").alias("image_id"), F.col("row").cast("int"), F.col("col").cast("int"))
    # the plan doesn't see how many addresses a box has, so it must not broadcast them
    return cells.hint("merge").join(pixels, ["image_id", "row", "col"])


def crown_crop(markers: DataFrame, tiles: DataFrame, size: int, width: int, height: int, side: int = rasters.SIZE) -> DataFrame:
    """Perspective crop around each marker from its panorama, nearest pixel.

    ``markers``: ``marker_id, image_id, yaw, pitch, hfov, vfov`` in degrees; ``tiles`` of ``side``
    pixels (see ``rasters``). Output ``marker_id, image_id, crop_row, crop_col, r, g, b``.
    """
    def locate(o: dict, row: np.ndarray, col: np.ndarray) -> dict[str, np.ndarray]:
        yaw, pitch = np.radians(o["yaw"]), np.radians(o["pitch"])
        ahead = np.array([np.cos(pitch) * np.cos(yaw), np.cos(pitch) * np.sin(yaw), np.sin(pitch)])
        flat = np.sqrt(ahead[0] * ahead[0] + ahead[1] * ahead[1])
        right = np.array([1.0, 0.0, 0.0]) if flat < 1e-6 else np.array([-ahead[1] / flat, ahead[0] / flat, 0.0])
        up = np.cross(ahead, right)
        a = ((col + 0.5) / size * 2 - 1) * np.tan(np.radians(o["hfov"]) / 2)
        b = (1 - (row + 0.5) / size * 2) * np.tan(np.radians(o["vfov"]) / 2)
        d = [ahead[k] + a * right[k] + b * up[k] for k in range(3)]
        lat = np.arcsin(np.clip(d[2] / np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]), -1.0, 1.0))
        x = np.rint((np.arctan2(d[1], d[0]) + np.pi) / (2 * np.pi) * width - 0.5)
        y = np.rint((np.pi / 2 - lat) / np.pi * height - 0.5)
        return {"out_row": row, "out_col": col, "row": np.clip(y, 0, height - 1), "col": np.mod(x, width)}

    asked = markers.select("marker_id", "image_id", *[F.col(c).cast("double") for c in ("yaw", "pitch", "hfov", "vfov")])
    asked = asked.withColumn("_image", F.col("image_id"))
    out = rasters.resample(asked, tiles, ["marker_id", "_image"], size, size, height, width, locate, rasters.nearest, "r int, g int, b int", size=side)
    return out.select("marker_id", F.col("_image").alias("image_id"), F.col("out_row").alias("crop_row"), F.col("out_col").alias("crop_col"), "r", "g", "b")


def zenith_fisheye(images: DataFrame, tiles: DataFrame, size: int, width: int, height: int,
                   max_vza: float = 90.0, north: float = 0.0, side: int = rasters.SIZE) -> DataFrame:
    """Equidistant upward fisheye of each panorama, bilinear; outside the circle nothing is returned."""
    def locate(o: dict, row: np.ndarray, col: np.ndarray) -> dict[str, np.ndarray]:
        dx, dy = (col + 0.5) / size * 2 - 1, (row + 0.5) / size * 2 - 1
        r = np.hypot(dx, dy)
        row, col, dx, dy, r = (v[r <= 1.0] for v in (row, col, dx, dy, r))
        turn = (np.arctan2(dy, dx) + math.radians(north)) / (2 * math.pi) + 0.5
        x = (turn - np.floor(turn)) * width - 0.5
        y = r * math.radians(max_vza) / math.pi * height - 0.5
        x0, y0 = np.floor(x), np.clip(np.floor(y), 0, height - 2)
        return {"out_row": row, "out_col": col, "row": y0, "col": np.mod(x0, width), "fx": x - x0, "fy": y - y0}

    asked = images.select("image_id").withColumn("_image", F.col("image_id"))
    out = rasters.resample(asked, tiles, ["_image"], size, size, height, width, locate, rasters.bilinear, "r double, g double, b double", size=side)
    return out.withColumnRenamed("_image", "image_id")


def pano_blend(cameras: DataFrame, tiles: DataFrame, width: int, src_width: int, src_height: int, sx: int = 1, sy: int = -1,
               forward: float = -1.0, side: int = rasters.SIZE) -> DataFrame:
    """Weighted panorama from the posed images of each scan, all ``src_width`` x ``src_height``.

    ``cameras``: ``pano_id, image_id, qw..qz, fpx, cx, cy``. A camera works on the output blocks
    near its view only, and meets the tiles that they touch. Dark samples (mean 8 or
    less) do not count; uncovered pixels are absent.
    """
    height = width // 2

    def axes(o: dict) -> list[np.ndarray]:
        w, x, y, z = (o[k] for k in ("qw", "qx", "qy", "qz"))
        r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
                      [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
                      [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
        return [r[:, 0], r[:, 1], forward * r[:, 2]]

    def rays(row: np.ndarray, col: np.ndarray) -> list[np.ndarray]:
        lon = col / width * 2 * math.pi - math.pi
        lat = math.pi / 2 - row / height * math.pi
        return [np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)]

    def locate(o: dict, row: np.ndarray, col: np.ndarray) -> dict[str, np.ndarray]:
        d = rays(row + 0.5, col + 0.5)
        a, b, along = (d[0] * v[0] + d[1] * v[1] + d[2] * v[2] for v in axes(o))
        front = along > 1e-6
        row, col, a, b, along = (v[front] for v in (row, col, a, b, along))
        u, v = o["cx"] + sx * o["fpx"] * (a / along), o["cy"] + sy * o["fpx"] * (b / along)
        return {"out_row": row, "out_col": col, "row": np.floor(v), "col": np.floor(u), "w": np.minimum(along, 1.0) ** 3}

    def skip(o: dict, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Blocks whose centre is farther from the view axis than the image corner plus their own reach."""
        d = rays(row, col)
        off = np.arccos(np.clip(sum(x * y for x, y in zip(d, axes(o)[2])), -1.0, 1.0))
        corner = math.atan(math.hypot(max(o["cx"], src_width - o["cx"]), max(o["cy"], src_height - o["cy"])) / o["fpx"])
        return off > corner + (rasters.BLOCK + 1) * math.pi / height

    def weighted(s: dict[str, np.ndarray], at) -> dict[str, np.ndarray]:
        p = at(0, 0).astype(np.float64)
        return {**{c: s["w"] * p[:, k] for k, c in enumerate("rgb")}, "w": s["w"], "keep": (p >= 0).all(axis=1) & (p.sum(axis=1) / 3.0 > 8)}

    asked = cameras.select("pano_id", "image_id", *[F.col(c).cast("double") for c in ("qw", "qx", "qy", "qz", "fpx", "cx", "cy")])
    out = rasters.resample(asked, tiles, ["pano_id"], height, width, src_height, src_width, locate, weighted,
                           "r double, g double, b double, w double", skip, side)
    return out.groupBy("pano_id", "out_row", "out_col").agg(*[(F.sum(c) / F.sum("w")).alias(c) for c in ("r", "g", "b")])


def coverage(image: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """Share of output pixels that received a value, in percent."""
    return image.groupBy(*keys).agg((F.count(F.lit(1)) * 100.0 / (width * height)).alias("coverage_pct"))


def assignment_share(points: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Per group the points, those with a tree, their share in percent and the number of different trees hit."""
    hit = F.coalesce(F.col(label) > 0, F.lit(False))
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"), F.count_if(hit).alias("n_assigned"), (F.avg(hit.cast("double")) * 100).alias("share_pct"),
                                     F.countDistinct(F.when(hit, F.col(label))).alias("trees_hit"))


def zbuffer_render(points: DataFrame, cameras: DataFrame, splat: int = 5) -> DataFrame:
    """Rendered image per camera: each point covers splat x splat pixels, the nearest wins."""
    rad = splat // 2
    seen = visible(points, cameras)
    grid = F.array(*[F.struct(F.lit(dv).alias("dv"), F.lit(du).alias("du")) for dv in range(-rad, rad + 1) for du in range(-rad, rad + 1)])
    dots = seen.withColumn("_k", F.explode(grid)).select(
        "camera_id", "depth", "point_idx", "r", "g", "b",
        F.least(F.greatest(F.floor("v") + F.col("_k.dv"), F.lit(0)), F.col("height") - 1).cast("int").alias("row"),
        F.least(F.greatest(F.floor("u") + F.col("_k.du"), F.lit(0)), F.col("width") - 1).cast("int").alias("col"))
    best = dots.groupBy("camera_id", "row", "col").agg(F.min(F.struct("depth", "point_idx", "r", "g", "b")).alias("p"))
    return best.select("camera_id", "row", "col", "p.depth", "p.r", "p.g", "p.b")


def rasterize_view(points: DataFrame, keys: list[str], width: int, height: int, horizontal: str = "x",
                   vertical: str = "y") -> DataFrame:
    """Orthographic picture of each cloud, last point wins, row 0 at the top."""
    ends = points.groupBy(*keys).agg(F.min(horizontal).alias("_h0"), F.max(horizontal).alias("_h1"),
                                     F.min(vertical).alias("_v0"), F.max(vertical).alias("_v1"))
    out = salted_join(points, broadcast_if_small(ends), keys) if keys else points.crossJoin(F.broadcast(ends))

    def scaled(c, lo, hi, n):
        return F.floor((F.col(c) - F.col(lo)) / F.greatest(F.col(hi) - F.col(lo), F.lit(1e-6)) * (n - 1)).cast("int")

    out = out.withColumn("row", F.lit(height - 1) - scaled(vertical, "_v0", "_v1", height)).withColumn(
        "col", scaled(horizontal, "_h0", "_h1", width))
    best = out.groupBy(*keys, "row", "col").agg(F.max(F.struct("point_idx", "r", "g", "b")).alias("p"))
    return best.select(*keys, "row", "col", "p.r", "p.g", "p.b")


def standpoints(cameras: DataFrame, ref: tuple[float, float, float]) -> DataFrame:
    """Scanner positions in the common y-up scene frame with their distance to the reference."""
    pos = geometry.y_up(F.col("tx"), F.col("ty"), F.col("tz"), *[F.lit(float(v)) for v in ref])
    return cameras.select("camera_id", *[p.alias(n) for p, n in zip(pos, ("pos_x", "pos_y", "pos_z"))],
                          geometry.distance3(*pos).alias("distance_m"))
