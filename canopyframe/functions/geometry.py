"""Angles, frames, rotations, projections and cylinders as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance3(dx: Column, dy: Column, dz: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def yaw_deg(dx: Column, dy: Column) -> Column:
    """Direction in the plane, degrees from the x axis."""
    return F.degrees(F.atan2(dy, dx))


def pitch_deg(dx: Column, dy: Column, dz: Column) -> Column:
    """Elevation in degrees; null at the origin."""
    return F.degrees(F.asin(F.try_divide(dz, distance3(dx, dy, dz))))


def y_up(x: Column, y: Column, z: Column, ox: Column, oy: Column, oz: Column) -> list[Column]:
    """z-up world to a y-up scene around an origin: ``(x-ox, z-oz, -(y-oy))``."""
    return [x - ox, z - oz, -(y - oy)]


def direction(yaw: Column, pitch: Column) -> list[Column]:
    """Unit vector of a yaw/pitch pair in degrees."""
    y, p = F.radians(yaw), F.radians(pitch)
    return [F.cos(p) * F.cos(y), F.cos(p) * F.sin(y), F.sin(p)]


def rotation(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    """Rotation matrix of a unit quaternion."""
    return [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
            [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
            [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]


def quaternion(m: list[list[Column]]) -> list[Column]:
    """Unit quaternion (w, x, y, z) of a rotation matrix, stable in all four sign cases."""
    trace = m[0][0] + m[1][1] + m[2][2]
    cases = [trace > 0, (m[0][0] > m[1][1]) & (m[0][0] > m[2][2]), m[1][1] > m[2][2]]
    # four times the square of the largest component of the quaternion
    big = [1 + trace, 1 + m[0][0] - m[1][1] - m[2][2], 1 + m[1][1] - m[0][0] - m[2][2], 1 + m[2][2] - m[0][0] - m[1][1]]
    a, b, c = m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]
    d, e, f = m[0][1] + m[1][0], m[0][2] + m[2][0], m[1][2] + m[2][1]
    rows = [[big[0], a, b, c], [a, big[1], d, e], [b, d, big[2], f], [c, e, f, big[3]]]
    parts = []
    for k in range(4):
        value = rows[3][k] / (2 * F.sqrt(F.abs(big[3])))
        for case in (2, 1, 0):
            value = F.when(cases[case], rows[case][k] / (2 * F.sqrt(F.abs(big[case])))).otherwise(value)
        parts.append(value)
    norm = F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
    return [p / norm for p in parts]


def world_to_camera(q: list[Column], center: list[Column]) -> tuple[list[list[Column]], list[Column]]:
    """Pose of a z-backward scanner camera as the x-right, y-down, z-forward extrinsics (R, t)."""
    r = rotation(*q)
    signs = (1, -1, -1)
    rot = [[r[j][i] * signs[i] for j in range(3)] for i in range(3)]
    t = [-(rot[i][0] * center[0] + rot[i][1] * center[1] + rot[i][2] * center[2]) for i in range(3)]
    return rot, t


def project(rot: list[list[Column]], t: list[Column], p: list[Column], fx: Column, fy: Column,
            cx: Column, cy: Column) -> tuple[Column, Column, Column]:
    """Pinhole projection: image u, v and depth. u and v are null at depth 0."""
    cam = [rot[i][0] * p[0] + rot[i][1] * p[1] + rot[i][2] * p[2] + t[i] for i in range(3)]
    return F.try_divide(fx * cam[0], cam[2]) + cx, F.try_divide(fy * cam[1], cam[2]) + cy, cam[2]


def equirect_pixel(dx: Column, dy: Column, dz: Column, width: int, height: int) -> tuple[Column, Column]:
    """Nearest panorama pixel (row, col) of a unit direction; columns wrap, rows clamp."""
    lon, lat = F.atan2(dy, dx), F.asin(F.least(F.greatest(dz, F.lit(-1.0)), F.lit(1.0)))
    col = F.rint((lon + math.pi) / (2 * math.pi) * width - 0.5)
    row = F.rint((F.lit(math.pi / 2) - lat) / math.pi * height - 0.5)
    return (F.least(F.greatest(row, F.lit(0.0)), F.lit(height - 1.0)).cast("int"),
            F.pmod(col, F.lit(float(width))).cast("int"))


def crop_window(pitch: Column, distance: Column, height: Column, fov: float | None = None) -> tuple[Column, Column]:
    """Centre pitch and field of view of a crown crop from tree height and distance."""
    if fov is not None:
        return pitch, F.lit(float(fov))
    known = (distance > 0.5) & (height != 0)
    half = F.degrees(F.atan(F.try_divide(height / 2, distance)))
    view = F.least(F.greatest(half * 2 * 1.4, F.lit(12.0)), F.lit(70.0))
    lifted = F.least(F.greatest(pitch + F.least(view / 2, half), F.lit(-85.0)), F.lit(85.0))
    return F.when(known, lifted).otherwise(pitch), F.when(known, view).otherwise(F.lit(25.0))


def cylinder(length: Column, radius: Column) -> tuple[Column, Column]:
    """Volume and lateral surface."""
    return F.lit(math.pi) * radius * radius * length, F.lit(2 * math.pi) * radius * length


def metres_to_degrees(metres: Column, lat: Column) -> tuple[Column, Column]:
    """Latitude and longitude steps of a length on the ground."""
    return metres / 111320.0, metres / (111320.0 * F.greatest(F.cos(F.radians(lat)), F.lit(1e-6)))


def slope_aspect(north: Column, south: Column, east: Column, west: Column, step: float = 30.0):
    """Slope, aspect in the reference convention and compass bearing of the downhill direction."""
    dzdx, dzdy = (east - west) / (2 * step), (north - south) / (2 * step)
    slope = F.degrees(F.atan(F.hypot(dzdx, dzdy)))
    tilted = slope >= 0.1
    ref = F.pmod(F.degrees(F.atan2(dzdy, -dzdx)) + 360.0, F.lit(360.0))
    compass = F.pmod(F.degrees(F.atan2(-dzdx, -dzdy)) + 360.0, F.lit(360.0))
    return slope, F.when(tilted, ref), F.when(tilted, compass)


#: Rotations of the eigenvector search: twelve sweeps over the three planes, far beyond what doubles need.
JACOBI_STEPS = 36


def smallest_axis(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> Column:
    """Unit eigenvector, as an array, of the smallest eigenvalue of a symmetric 3x3 matrix.

    Jacobi rotations folded over a column: each step clears the first off-diagonal
    entry and then renames the axes in a circle, so the next step has the next one
    in its place. The matrix of zeros gives the first axis.
    """
    one, zero = F.lit(1.0), F.lit(0.0)
    start = F.struct(*[c.cast("double").alias(n) for n, c in zip(("a", "b", "c", "ab", "ac", "bc"), (xx, yy, zz, xy, xz, yz))],
                     *[F.array(*[one if i == k else zero for i in range(3)]).alias(n) for k, n in enumerate(("va", "vb", "vc"))])

    def let(value: Column, use) -> Column:
        """``use`` of a value that is computed once."""
        return F.transform(F.array(value), use)[0]

    def step(m: Column, _: Column) -> Column:
        theta = (m["b"] - m["a"]) / (2 * m["ab"])
        tangent = F.when(m["ab"] == 0, zero).otherwise(F.when(theta < 0, -one).otherwise(one) / (F.abs(theta) + F.sqrt(theta * theta + 1)))

        def rotated(t: Column) -> Column:
            def with_cosine(c: Column) -> Column:
                s = t * c
                turn = lambda p, q: (c * p - s * q, s * p + c * q)
                ac, bc = turn(m["ac"], m["bc"])
                va = F.zip_with(m["va"], m["vb"], lambda p, q: turn(p, q)[0])
                vb = F.zip_with(m["va"], m["vb"], lambda p, q: turn(p, q)[1])
                # the axes b, c, a take the names a, b, c
                return F.struct((m["b"] + t * m["ab"]).alias("a"), m["c"].alias("b"), (m["a"] - t * m["ab"]).alias("c"), bc.alias("ab"), zero.alias("ac"), ac.alias("bc"),
                                vb.alias("va"), m["vc"].alias("vb"), va.alias("vc"))

            return let(1 / F.sqrt(t * t + 1), with_cosine)

        return let(tangent, rotated)

    def least(m: Column) -> Column:
        return F.when((m["a"] <= m["b"]) & (m["a"] <= m["c"]), m["va"]).when(m["b"] <= m["c"], m["vb"]).otherwise(m["vc"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(JACOBI_STEPS)), start, step, least)
