"""Tiled images against resampling of the whole array."""

import math
import struct
import zlib

import numpy as np
import pytest

from canopyframe.operators import cameras as cam
from canopyframe.operators import rasters

W, H, SIDE = 700, 350, 128


def _image(w=W, h=H):
    rng = np.random.default_rng(3)
    return rng.integers(0, 256, (h, w, 3)).astype(np.int16)


def _table(spark, images, wrap, side=SIDE):
    rows = [(k, r, c, bytearray(d)) for k, image in images.items() for r, c, d in rasters.tiles_of(image, wrap, side)]
    return spark.createDataFrame(rows, "image_id bigint, trow int, tcol int, data binary")


def _png(path, image):
    h, w = image.shape[:2]
    body = b"".join(b"\0" + image[r].astype(np.uint8).tobytes() for r in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b""))


@pytest.mark.parametrize("wrap, w, h, side", [(True, 70, 35, 16), (False, 64, 32, 32), (True, 16, 8, 16)])
def test_tiles_of_pixels_and_files(spark, tmp_path, wrap, w, h, side):
    image = _image(w, h)
    pixels = spark.createDataFrame([(1, r, c, *map(int, image[r, c])) for r in range(h) for c in range(w)] + [(1, h, 0, 1, 1, 1), (1, 0, -1, 1, 1, 1)],
                                   "image_id bigint, row int, col int, r int, g int, b int")
    want = {(r, c): d for r, c, d in rasters.tiles_of(image, wrap, side)}
    assert {(t.trow, t.tcol): bytes(t.data) for t in rasters.pixel_tiles(pixels, w, h, wrap, side).collect()} == want
    _png(tmp_path / "a.png", image)
    got = rasters.read_image_tiles(spark, str(tmp_path), wrap, side).collect()
    assert {(t.trow, t.tcol): bytes(t.data) for t in got} == want and {t.image_id for t in got} == {"a.png"}


def test_crown_crop(spark):
    image = _image()
    marks = [(1, 7, 10.0, 5.0, 50.0, 40.0), (2, 7, 179.9, -70.0, 60.0, 60.0), (3, 7, -90.0, 89.9999999, 25.0, 25.0), (4, 8, 0.0, 0.0, 30.0, 30.0)]
    markers = spark.createDataFrame(marks, "marker_id bigint, image_id bigint, yaw double, pitch double, hfov double, vfov double")
    got = cam.crown_crop(markers, _table(spark, {7: image}, True), 90, W, H, SIDE).collect()
    assert len(got) == 3 * 90 * 90
    for mark, _, yaw, pitch, hfov, vfov in marks[:3]:
        c = np.array([math.cos(math.radians(pitch)) * math.cos(math.radians(yaw)), math.cos(math.radians(pitch)) * math.sin(math.radians(yaw)), math.sin(math.radians(pitch))])
        flat = math.hypot(c[0], c[1])
        right = np.array([-c[1] / flat, c[0] / flat, 0.0]) if flat >= 1e-6 else np.array([1.0, 0.0, 0.0])
        up = np.cross(c, right)
        same = total = 0
        for p in (p for p in got if p.marker_id == mark):
            d = c + ((p.crop_col + 0.5) / 90 * 2 - 1) * math.tan(math.radians(hfov) / 2) * right + (1 - (p.crop_row + 0.5) / 90 * 2) * math.tan(math.radians(vfov) / 2) * up
            x = round((math.atan2(d[1], d[0]) + math.pi) / (2 * math.pi) * W - 0.5) % W
            y = min(max(round((math.pi / 2 - math.asin(d[2] / np.linalg.norm(d))) / math.pi * H - 0.5), 0), H - 1)
            same += tuple(image[y, x]) == (p.r, p.g, p.b)
            total += 1
        assert same >= total - 2  # roundings at a pixel's edge


def test_zenith_fisheye_across_the_seam(spark):
    image = _image()
    images = spark.createDataFrame([(7,)], "image_id bigint")
    got = {(p.out_row, p.out_col): (p.r, p.g, p.b) for p in cam.zenith_fisheye(images, _table(spark, {7: image}, True), 100, W, H, 80.0, 30.0, SIDE).collect()}
    want = {}
    for i in range(100):
        for j in range(100):
            dx, dy = (j + 0.5) / 50 - 1, (i + 0.5) / 50 - 1
            r = math.hypot(dx, dy)
            if r <= 1:
                turn = (math.atan2(dy, dx) + math.radians(30)) / (2 * math.pi) + 0.5
                x, y = (turn - math.floor(turn)) * W - 0.5, r * math.radians(80) / math.pi * H - 0.5
                x0, y0 = math.floor(x), min(max(math.floor(y), 0), H - 2)
                want[(i, j)] = np.clip(sum((x - x0 if b else 1 - (x - x0)) * (y - y0 if a else 1 - (y - y0)) * image[y0 + a, (x0 + b) % W]
                                           for a in (0, 1) for b in (0, 1)), 0, 255)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)


def test_pano_blend(spark):
    rng = np.random.default_rng(5)
    images = {k: rng.integers(0, 256, (60, 80, 3)).astype(np.int16) for k in range(4)}
    images[2][:30] = 2  # dark
    quats = rng.normal(size=(4, 4))
    quats /= np.linalg.norm(quats, axis=1, keepdims=True)
    rows = [(1, k, *map(float, quats[k]), 45.0, 39.0, 31.0) for k in range(4)]
    cameras = spark.createDataFrame(rows, "pano_id bigint, image_id bigint, qw double, qx double, qy double, qz double, fpx double, cx double, cy double")
    got = {(p.out_row, p.out_col): (p.r, p.g, p.b) for p in cam.pano_blend(cameras, _table(spark, images, False, 32), 256, 80, 60, side=32).collect()}
    sums = np.zeros((128, 256, 4))
    for k in range(4):
        w, x, y, z = quats[k]
        r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
                      [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
        for i in range(128):
            for j in range(256):
                lon, lat = (j + 0.5) / 256 * 2 * math.pi - math.pi, math.pi / 2 - (i + 0.5) / 128 * math.pi
                a, b, f = np.array([math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)]) @ r
                if -f > 1e-6:
                    u, v = math.floor(39 + 45 * a / -f), math.floor(31 - 45 * b / -f)
                    if 0 <= u < 80 and 0 <= v < 60 and images[k][v, u].sum() / 3 > 8:
                        sums[i, j] += min(-f, 1) ** 3 * np.append(images[k][v, u], 1)
    want = {(i, j): sums[i, j, :3] / sums[i, j, 3] for i, j in zip(*np.nonzero(sums[..., 3]))}
    assert len(got.keys() ^ want.keys()) <= 2 and len(want) > 3000
    assert sum(not np.allclose(got[k], want[k], atol=1e-6) for k in got.keys() & want.keys()) <= 3
