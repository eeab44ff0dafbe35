"""A text file read by many tasks equals the same file read by one."""

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from canopyframe.sources import clouds, lines, tables


@contextmanager
def ranges_of(spark, size):
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_numbers_do_not_depend_on_ranges(spark, tmp_path):
    rng = random.Random(2)
    texts = {f"f{k}.txt": [rng.choice(["", " ", "# note", "x" * rng.randrange(200), f"{i}"]) for i in range(rng.randrange(400, 900))] for k in range(3)}
    for name, rows in texts.items():
        (tmp_path / name).write_text("\n".join(rows) + ("\n" if name == "f1.txt" else ""))
    for keep in (None, ~F.col("value").startswith("#")):
        want = sorted((n.split(".")[0], i, v) for n, rows in texts.items()
                      for i, v in enumerate(r for r in (rows if rows[-1] or n == "f1.txt" else rows[:-1]) if keep is None or not r.startswith("#")))
        for size in (700, 10**8):
            with ranges_of(spark, size):
                got = lines.numbered_lines(spark, str(tmp_path), keep).withColumn("file", lines.stem_of(F.col("file")))
                assert sorted(map(tuple, got.collect())) == want
                assert size > 700 or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20


@pytest.mark.parametrize("size", [600, 10**8])
def test_pcd_labels_grid_and_images(spark, tmp_path, size):
    rng = random.Random(3)
    points = [(rng.uniform(-9, 9), rng.uniform(-9, 9), rng.uniform(0, 9), rng.randrange(1 << 24)) for _ in range(500)]
    (tmp_path / "p").mkdir()
    for name in ("a", "b"):
        rows = points if name == "a" else points[:7]
        head = f"# .PCD\nVERSION .7\nFIELDS x y n z rgb\nSIZE 4 4 4 4 4\nTYPE F F F F U\nCOUNT 1 1 2 1 1\nWIDTH {len(rows)}\nHEIGHT 1\nPOINTS {len(rows)}\nDATA ascii\n"
        (tmp_path / "p" / f"{name}.pcd").write_text(head + "".join(f"{x:.6f} {y:.6f} 1 2 {z:.6f} {c}\n" for x, y, z, c in rows))
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.labels").write_text("\n".join(str(i % 9 - 1) for i in range(500)))
    cells = [[rng.choice([-9999, rng.randrange(90)]) for _ in range(31)] for _ in range(45)]
    (tmp_path / "g.asc").write_text("ncols 31\nnrows 45\nxllcorner 10\nyllcorner 20\ncellsize 2\nNODATA_value -9999\n" + "\n".join(" ".join(map(str, r)) for r in cells))
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "cameras.txt").write_text("# c\n1 PINHOLE 640 480 1 2 3 4\n")
    (tmp_path / "m" / "points3D.txt").write_text("1 0 0 0 1 2 3 0.5\n")
    (tmp_path / "m" / "images.txt").write_text("# a\n# b\n" + "".join(f"{i} 1 0 0 0 {i}.5 2 3 1 n{i}.jpg\n" + ("\n" if i % 2 else "1 2 3 4 5 6 7 8 9 10 11\n") for i in range(200)))
    with ranges_of(spark, size):
        cloud = lines.read_pcd_text(spark, str(tmp_path / "p"))
        got = {(r.tile_id, r.point_idx): r for r in cloud.collect()}
        assert len(got) == 507
        for i, (x, y, z, c) in enumerate(points):
            r = got[("a", i)]
            assert abs(r.x - x) < 1e-5 and abs(r.y - y) < 1e-5 and abs(r.z - z) < 1e-5 and (r.r, r.g, r.b) == (c >> 16, c >> 8 & 255, c & 255)
        labels = lines.read_point_labels(spark, str(tmp_path / "l"))
        both = clouds.attach_labels(cloud.where("tile_id = 'a'"), labels)
        assert {r.point_idx: r.label for r in both.collect()} == {i: i % 9 - 1 for i in range(500)}
        with pytest.raises(ValueError):
            clouds.attach_labels(cloud, labels)
        grid = {(r.row, r.col): (r.x, r.y, r.value) for r in tables.read_ascii_grid(spark, str(tmp_path / "g.asc")).collect()}
        assert grid == {(i, j): (10 + (j + 0.5) * 2, 20 + (45 - i - 0.5) * 2, None if v == -9999 else float(v)) for i, r in enumerate(cells) for j, v in enumerate(r)}
        images = tables.read_colmap(spark, str(tmp_path / "m"))["images"]
        assert sorted((r.image_id, r.px, r.name) for r in images.collect()) == [(i, i + 0.5, f"n{i}.jpg") for i in range(200)]
