"""Write a file, read it back, compare row by row."""

import io
import json
import math
import struct
import zipfile
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyframe.operators.sampling import lod_levels
from canopyframe.plans.carriers import carrier
from canopyframe.sources import clouds, files, tables


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    clouds.register_sources(spark)


@pytest.fixture(scope="module")
def points(spark, sf_dir):
    return carrier(spark, sf_dir, "points").cache()


def same_rows(got, want, cols, tol=1.1e-3):
    """Both frames hold the same rows up to ``tol``: every column and a mix of all columns, sorted."""
    a, b = (np.array([[float(r[c]) for c in cols] for r in df.select(*cols).collect()]) for df in (got, want))
    assert a.shape == b.shape
    mix = np.linspace(0.3, 1.0, len(cols))
    for u, v in [*zip(a.T, b.T), (a @ mix, b @ mix)]:
        assert np.abs(np.sort(u) - np.sort(v)).max() <= tol * len(cols)


def pcd_bytes(rows, fmt, packed=True):
    head = "# comment\nVERSION .7\nFIELDS x y z rgb n\nSIZE 4 4 4 4 4\nTYPE F F F U F\nCOUNT 1 1 1 1 2\nWIDTH 9\nHEIGHT 1\n"
    head += f"POINTS {len(rows)}\nDATA {fmt}\n"
    if fmt == "ascii":
        return (head + "".join(f"{x} {y} {z} {(r << 16) | (g << 8) | b} 0 1\n" for x, y, z, r, g, b in rows)).encode()
    return head.encode() + b"".join(struct.pack("<fffIff", x, y, z, (r << 16) | (g << 8) | b, 0, 1) for x, y, z, r, g, b in rows)


@pytest.mark.parametrize("fmt", ["ascii", "binary"])
def test_pcd(spark, points, tmp_path, fmt, monkeypatch):
    rows = [tuple(r) for r in points.limit(500).select("x", "y", "z", "r", "g", "b").collect()]
    (tmp_path / "plot7.pcd").write_bytes(pcd_bytes(rows, fmt))
    got = spark.read.format("pcd").load(str(tmp_path / "plot7.pcd")).orderBy("point_idx").collect()
    assert len(got) == 500 and got[0].tile_id == "plot7"
    for g, w in zip(got, rows):
        assert (g.x, g.y, g.z) == pytest.approx(w[:3], abs=1e-4) and (g.r, g.g, g.b) == w[3:]


def test_pcd_rejects_compressed(spark, tmp_path):
    (tmp_path / "a.pcd").write_bytes(b"FIELDS x\nSIZE 4\nTYPE F\nPOINTS 1\nDATA binary_compressed\n")
    with pytest.raises(Exception, match="not supported"):
        spark.read.format("pcd").load(str(tmp_path)).count()


def test_labels_join_and_mismatch(spark, points, tmp_path):
    rows = [tuple(r) for r in points.limit(50).select("x", "y", "z", "r", "g", "b").collect()]
    (tmp_path / "s.pcd").write_bytes(pcd_bytes(rows, "binary"))
    (tmp_path / "s.labels").write_text("".join(f"{i % 5 - 1}\n" for i in range(50)))
    cloud = spark.read.format("pcd").load(str(tmp_path))
    both = clouds.attach_labels(cloud, spark.read.format("pointlabels").load(str(tmp_path / "s.labels")))
    assert {(r.point_idx, r.label) for r in both.collect()} == {(i, i % 5 - 1) for i in range(50)}
    (tmp_path / "s.labels").write_text("1\n2\n")
    with pytest.raises(ValueError, match="differ"):
        clouds.attach_labels(cloud, spark.read.format("pointlabels").load(str(tmp_path / "s.labels")))


def test_las_round_trip_and_window(spark, points, tmp_path):
    path = str(tmp_path / "out")
    src = points.withColumn("intensity", F.col("z") * 10)
    tables.write_las(src, path)
    back = spark.read.format("las").load(path)
    same_rows(back, points, ["x", "y", "z"])
    ends = back.agg(F.min("intensity"), F.max("intensity"), F.max("red")).first()
    assert (ends[0], ends[1]) == (0, 65535) and ends[2] == 257 * points.agg(F.max("r")).first()[0]
    cut = spark.read.format("las").options(window="3,-1,9,2", zrange="1,200", classes="0,1").load(path)
    assert cut.count() == back.where("x between 3 and 9 and y between -1 and 2 and z between 1 and 200 and class in (0, 1)").count() > 0
    # filters on the frame leave later queries on it alone
    assert back.where("class = 2").count() == points.where("class = 2").count()
    assert back.count() == points.count()
    far = clouds.LasReader({"path": path, "window": "1e6,0,2e6,1"})
    assert all(p.start == p.stop for p in far.partitions())


@pytest.mark.parametrize("layout", ["blocks", "segmented", "pcb1"])
def test_block_binary(spark, points, tmp_path, layout, monkeypatch):
    path = str(tmp_path / layout)
    monkeypatch.setattr(files, "SPLIT_BYTES", 10_000)
    src = points.withColumn("seg_id", F.col("label"))
    tables.write_cloud(src.repartition(3), path, (1.0, 2.0, 0.5), layout)
    back = spark.read.format("cloudbin").option("layout", layout).load(path)
    if layout == "pcb1":
        back = back.withColumn("_y", -F.col("z")).withColumn("z", F.col("y")).withColumn("y", F.col("_y"))
    moved = points.withColumns({"x": F.col("x") - 1, "y": F.col("y") - 2, "z": F.col("z") - 0.5, "seg_id": F.col("label")})
    cols = ["x", "y", "z", "r", "g", "b"] + (["seg_id"] if layout == "segmented" else [])
    same_rows(back, moved, cols)
    meta = files.folder_facts(path)
    assert meta["count"] == points.count() and len(meta["parts"]) == 3 and len(meta["bbox_min"]) == 3


class _Plain(files.PartWriter):
    suffix = ".txt"

    def encode(self, batches, spool):
        block = spool()
        block.write(b"".join(batches))
        return b"", [block], {"count": len(batches)}


def test_writers_at_the_same_time_lose_nothing(tmp_path):
    folder = str(tmp_path / "shared")
    with ThreadPoolExecutor(8) as pool:
        def job(k):
            writer = _Plain({"path": folder})
            writer.commit([writer.write([b"%d\n" % k]), writer.write([]), None])
        list(pool.map(job, range(24)))
    read = lambda: sorted(open(f).read() for f, _ in files.list_files(folder, (".txt",)))
    assert read() == sorted(f"{k}\n" for k in range(24)) and files.folder_facts(folder)["count"] == 24
    early, late = _Plain({"path": folder, "overwrite": True}), _Plain({"path": folder})
    first, second = early.write([b"new\n"]), late.write([b"more\n"])
    late.commit([second])
    early.commit([first])
    assert read() == ["new\n"] and len(list((tmp_path / "shared").glob("part-*"))) == 1
    late.commit([late.write([b"last\n"])])
    assert read() == ["last\n", "new\n"]
    lost = late.write([b"aborted\n"])
    late.abort([lost])
    assert read() == ["last\n", "new\n"] and len(list((tmp_path / "shared").glob("part-*"))) == 2


def test_overwrite_replaces_and_append_adds(spark, points, tmp_path):
    path = str(tmp_path / "cloud")
    for mode, n, want in (("append", 9, 9), ("overwrite", 5, 5), ("append", 3, 8)):
        points.limit(n).write.format("cloudbin").mode(mode).option("layout", "pcb1").save(path)
        assert spark.read.format("cloudbin").option("layout", "pcb1").load(path).count() == want == files.folder_facts(path)["count"]


def test_cylinders(spark, tmp_path):
    start, end = np.arange(12, dtype="<f4").reshape(4, 3), np.arange(12, 24, dtype="<f4").reshape(4, 3)
    radius, order = np.array([.1, .2, .3, .4], "<f4"), np.array([1, 1, 2, 3], "<f4")
    (tmp_path / "Oak_1.bin").write_bytes(start.tobytes() + end.tobytes() + radius.tobytes() + order.tobytes())
    (tmp_path / "Oak_1.json").write_text(json.dumps({"off": [100.0, 200.0, 5.0], "count": 4, "order_max": 3}))
    from canopyframe.operators.cylinders import cylinder_geometry, cylinders_to_world
    df = spark.read.format("cloudbin").option("layout", "cylinders").load(str(tmp_path))
    world = cylinders_to_world(df.drop("off_x", "off_y", "off_z"), df.select("tree_id", "off_x", "off_y", "off_z").distinct())
    rows = cylinder_geometry(world).orderBy("cyl_idx").collect()
    assert [r.branch_order for r in rows] == [1, 1, 2, 3] and rows[1].start_x == 103.0 and rows[0].length_m == pytest.approx(12 * 3 ** .5)


def test_ply(spark, sf_dir, tmp_path):
    from canopyframe.operators.cylinders import points_to_splats
    pts = carrier(spark, sf_dir, "points")
    tables.write_ply(points_to_splats(pts), str(tmp_path / "m"))
    back = spark.read.format("plyvertex").load(str(tmp_path / "m"))
    assert back.columns[2:12] == ["x", "y", "z", "nx", "ny", "nz", "f_dc_0", "f_dc_1", "f_dc_2", "opacity"]
    same_rows(back, pts, ["x", "y", "z"])


def test_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿x,y,z,label,Note\n1,2,3,A,\n4,5,oops,,n\n".encode())
    df = tables.read_csv(spark, str(tmp_path / "a.csv"), ("x", "y", "z"))
    assert df.columns == ["x", "y", "z", "label", "Note"] and df.count() == 2
    with pytest.raises(ValueError, match="missing"):
        tables.read_csv(spark, str(tmp_path / "a.csv"), ("dbh_cm",))


def test_tsv_text_and_zip(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("t1\t511\t30.5\t22\n\nt2\t211\t12\t9.5\n")
    assert [r.species_code for r in tables.read_tree_tsv(spark, str(tmp_path / "t.tsv")).orderBy("tree_id").collect()] == [511, 211]
    (tmp_path / "txt").mkdir()
    body = "1.0 2.0  3.0\n\n 4 5 6\n"
    (tmp_path / "txt" / "SiteA_tree1.txt").write_text(body)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("d/SiteA_tree1.txt", body)
    (tmp_path / "txt" / "a.zip").write_bytes(buf.getvalue())
    want = [("SiteA", "SiteA_tree1", 1.0, 2.0, 3.0), ("SiteA", "SiteA_tree1", 4.0, 5.0, 6.0)]
    assert sorted(map(tuple, tables.read_point_text(spark, str(tmp_path / "txt" / "*.txt")).collect())) == want
    assert sorted(map(tuple, tables.read_zipped_point_text(spark, str(tmp_path / "txt")).collect())) == want


def test_file_keys(spark, tmp_path):
    (tmp_path / "QuePet_BR01_01_2019-07-08_q1.txt").write_text("1 2 3\n")
    (tmp_path / "scan_017_x.txt").write_text("1 2 3\n")
    df = spark.read.text(str(tmp_path)).select(tables.file_key(tables.SETUP_PATTERN).alias("setup"), tables.file_key(tables.TREE_PATTERN).alias("tree"))
    assert ("017", "scan_017_x") in set(map(tuple, df.collect())) and "QuePet_BR01_01" in {r.tree for r in df.collect()}


def test_manifests_footprint_and_publish_list(spark, tmp_path):
    for sid, body in (("a", '{"id": "a", "title": "A"}'), ("b", "{broken"), ("c", '{"id": "c"}')):
        d = tmp_path / "scenes" / sid
        d.mkdir(parents=True)
        (d / "scene.json").write_text(body)
        (d / "cloud.bin").write_bytes(b"0" * 10)
    docs = tables.read_manifests(spark, str(tmp_path))
    got = docs.select(F.variant_get("doc", "$.id", "string").alias("id")).collect()
    assert sorted(r.id for r in got) == ["a", "c"]
    from canopyframe.operators.scenes import storage_footprint
    foot = {r.scene_id: (r.bytes, r.n_files) for r in storage_footprint(tables.read_footprint(spark, str(tmp_path))).collect()}
    assert foot["b"] == (17, 2)
    (tmp_path / "publish.json").write_text('{"publish": {"a": "note", "z": null}}')
    assert sorted(r.id for r in tables.read_publish_list(spark, str(tmp_path / "publish.json")).collect()) == ["a", "z"]
    assert tables.read_publish_list(spark, None) is None


def test_colmap(spark, points, sf_dir, tmp_path):
    from canopyframe.operators.cameras import pose_to_extrinsics
    images = pose_to_extrinsics(carrier(spark, sf_dir, "cameras")).withColumn("image_id", F.col("camera_id") + 1).withColumn(
        "name", F.format_string("s01_c%02d.jpg", "camera_id"))
    cam = spark.createDataFrame([(1, 640, 480, 400.0, 401.0, 320.0, 240.0)], "camera_id int, width int, height int, fx double, fy double, cx double, cy double")
    tables.write_colmap(str(tmp_path), cam, images, points.limit(200))
    for name in ("cameras", "images", "points3D"):
        merged = b"".join(p.read_bytes() for p in sorted((tmp_path / f"{name}.txt").glob("part-*")))
        target = tmp_path / "flat"
        target.mkdir(exist_ok=True)
        (target / f"{name}.txt").write_bytes(b"# header\n" + merged)
    model = tables.read_colmap(spark, str(tmp_path / "flat"))
    assert model["cameras"].first().fy == 401.0
    back = {r.image_id: r for r in model["images"].collect()}
    want = {r.image_id: r for r in images.collect()}
    assert set(back) == set(want) and back[3].name == want[3].name and back[3].px == pytest.approx(want[3].px, abs=1e-6)
    pts = model["points"].collect()
    assert sorted(r.point_idx for r in pts) == list(range(1, 201))


def test_ascii_grid(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1.5), (0, 2, None), (1, 1, -0.25)], "row int, col int, value double")
    tables.write_ascii_grid(cells, str(tmp_path / "g"), 3, 2, 100.0, 200.0, 0.5)
    text = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    assert text.splitlines()[6:] == ["1.5000 -9999.0000 -9999.0000", "-9999.0000 -0.2500 -9999.0000"]
    (tmp_path / "n.asc").write_text(text)
    back = {(r.row, r.col): r for r in tables.read_ascii_grid(spark, str(tmp_path / "n.asc")).collect()}
    assert len(back) == 6 and back[(0, 0)].value == 1.5 and back[(0, 1)].value is None
    assert (back[(0, 0)].x, back[(0, 0)].y) == (100.25, 200.75)


def test_inventory_csv_and_documents(spark, tmp_path):
    trees = spark.createDataFrame([(1.0, 2.0, "Tree 01", 30.0, None, 5)], "x double, y double, label string, dbh_cm double, height_m double, extra int")
    tables.write_inventory_csv(trees, str(tmp_path / "inv"))
    back = spark.read.csv(str(tmp_path / "inv"), header=True)
    assert tuple(back.columns) == tables.INVENTORY_COLUMNS and back.first().height_m is None
    docs = spark.createDataFrame([("a", None, 3)], "id string, title string, n int")
    tables.write_documents(docs, str(tmp_path / "docs"), "id")
    assert spark.read.text(str(tmp_path / "docs")).first().value == '{"title":null,"n":3}'


def _paged(payload: bytes) -> bytes:
    out = b""
    for k in range(0, len(payload), 1020):
        out += payload[k:k + 1020].ljust(1020, b"\0") + b"CRC!"
    return out


def test_e57_image_manifest(spark, tmp_path):
    jpeg = b"\xff\xd8\xff" + bytes(range(256)) * 8
    logical = bytearray(48)
    blob_at = len(logical)
    logical += b"\1" + b"\0" * 15 + jpeg
    xml_at = len(logical)
    physical = lambda at: at // 1020 * 1024 + at % 1020
    xml = (f'<e57Root xmlns="http://www.astm.org/COMMIT/E57/2010-e57-v1.0"><images2D><vectorChild><guid>{{g1}}</guid>'
           f'<pose><rotation><w>0.5</w><x>0.5</x><y>-0.5</y><z>0.5</z></rotation><translation><x>1</x><y>2.5</y><z>-3</z></translation></pose>'
           f'<pinholeRepresentation><jpegImage type="Blob" fileOffset="{physical(blob_at)}" length="{len(jpeg)}"/><imageWidth>64</imageWidth>'
           f'<imageHeight>48</imageHeight><focalLength>0.01</focalLength><pixelWidth>1e-5</pixelWidth><pixelHeight>1e-5</pixelHeight>'
           f'<principalPointX>32</principalPointX><principalPointY>24</principalPointY></pinholeRepresentation></vectorChild>'
           f'<vectorChild><guid>g2</guid><sphericalRepresentation/></vectorChild></images2D></e57Root>').encode()
    logical += xml
    logical[:48] = struct.pack("<8sIIQQQQ", b"ASTM-E57", 1, 0, 0, physical(xml_at), len(xml), 1024)
    (tmp_path / "setup01.e57").write_bytes(_paged(bytes(logical)))
    rows = spark.read.format("e57images").option("content", "true").load(str(tmp_path)).orderBy("image_idx").collect()
    assert [r.representation for r in rows] == ["pinholeRepresentation", "sphericalRepresentation"]
    assert (rows[0].width, rows[0].tx, rows[0].ty, rows[0].qy, rows[0].setup_id) == (64, 1.0, 2.5, -0.5, "setup01")
    assert bytes(rows[0].content) == jpeg and rows[1].content is None


def _png(rgb: np.ndarray) -> bytes:
    import zlib
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[i].tobytes() for i in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_pixels(spark, tmp_path):
    rgb = np.random.default_rng(1).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    (tmp_path / "p.png").write_bytes(_png(rgb))
    rows = tables.read_images(spark, str(tmp_path)).collect()
    assert len(rows) == 35
    assert all((r.r, r.g, r.b) == tuple(int(v) for v in rgb[r.row, r.col]) for r in rows)


def test_density_levels(spark, points, tmp_path):
    levels = lod_levels(points, {"lite": (0.5, 300), "full": (0.1, 2000)}).cache()
    rows = tables.write_levels(levels, str(tmp_path), ["lite", "full"], (0.0, 0.0, 0.0)).orderBy("level_no").collect()
    assert [r.level for r in rows] == ["lite", "full"] and rows[0]["count"] == 300
    back = spark.read.format("cloudbin").load(str(tmp_path / "lite"))
    assert back.count() == 300


def test_density_levels_read_the_points_once_for_their_columns(spark):
    cloud = spark.range(4000).selectExpr("concat('t', id % 2) as tile_id", "id div 4 as point_idx", "(id * 37 % 1000) / 100.0D as x", "(id * 91 % 1000) / 100.0D as y",
                                         "(id % 7) / 2.0D as z", "cast(id as int) as r")
    levels = lod_levels(cloud, {"lite": (1.0, 50), "full": (0.1, 10**6)})
    assert levels._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    rows = [r.asDict() for r in cloud.collect()]
    got = {n: {(r.tile_id, r.point_idx, r.x, r.y, r.z) for r in levels.where(f"level = '{n}'").collect()} for n in ("lite", "full")}
    for name, size in (("lite", 1.0), ("full", 0.1)):
        first = {}
        for r in rows:
            key = (r["tile_id"], *(math.floor(r[a] / size) for a in "xyz"))
            first[key] = min(first.get(key, r["point_idx"]), r["point_idx"])
        assert levels.where(f"level = '{name}'").count() == (100 if name == "lite" else len(first))
        assert {(t, i, *(math.floor(v / size) for v in p)) for t, i, *p in got[name]} <= {(k[0], i, *k[1:]) for k, i in first.items()}
