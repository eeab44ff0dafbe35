"""Readers and writers over Spark's built-in formats: tables, manifests, grids, camera models, images."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyframe.ranking import running_total
from canopyframe.runtime import broadcast_if_small
from canopyframe.sources.lines import HEADER_LINES, numbered_lines, stem_of, words_of

INVENTORY_COLUMNS = ("x", "y", "z", "label", "dbh_cm", "basal_area_m2", "height_m", "volume_m3", "observed_height_m",
                     "fit_rms_cm", "arc_deg", "n_points")


def file_key(pattern: str, group: int = 1):
    """Key taken from the name of the file a row came from."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    return F.regexp_extract(name, pattern, group)


#: Set-up number: first group of two or three digits of the file name.
SETUP_PATTERN = r"(\d{2,3})"
#: Tree key: file name before the date.
TREE_PATTERN = r"^(.*?)(?:_\d{4}-\d{2}-\d{2}_.*)?(?:\.[A-Za-z0-9]+)?$"


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Header CSV as text columns; a byte order mark is removed and required columns are checked."""
    df = spark.read.csv(path, header=True, encoding="UTF-8", inferSchema=False)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    missing = set(required) - set(df.columns)
    if missing:
        raise ValueError(f"columns missing in {path}: {sorted(missing)}")
    return df


def read_tree_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tree list without header: id, species code, diameter, height; blank lines are skipped."""
    df = spark.read.csv(path, sep="\t", schema="tree_id string, species_code int, dbh_cm double, height_m double")
    return df.where("tree_id is not null")


def read_point_text(spark: SparkSession, path: str, key_pattern: str = r"^([^_.]+)") -> DataFrame:
    """Whitespace separated x y z files, one tree per file; the site key is the name before the first underscore."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(
        file_key(key_pattern).alias("site"), file_key(r"^(.*?)(?:\.[^.]*)?$").alias("tree_id"),
        *[F.try_element_at(parts, F.lit(k + 1)).try_cast("double").alias(a) for k, a in enumerate("xyz")])


def read_zipped_point_text(spark: SparkSession, path: str) -> DataFrame:
    """The same files inside zip archives; members are streamed in batches."""
    import io
    import zipfile

    def expand(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                archive = zipfile.ZipFile(io.BytesIO(content))
                for member in sorted(n for n in archive.namelist() if n.lower().endswith(".txt")):
                    stem = member.rsplit("/", 1)[-1][:-4]
                    with archive.open(member) as f:
                        while lines := f.readlines(4 << 20):
                            rows = np.array([ln.split()[:3] for ln in lines if ln.strip()], dtype=np.float64).reshape(-1, 3)
                            yield pa.record_batch([pa.array([stem.split("_")[0]] * len(rows)), pa.array([stem] * len(rows)),
                                                   *[pa.array(rows[:, k]) for k in range(3)]], names=["site", "tree_id", "x", "y", "z"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("content")
    return files.mapInArrow(expand, "site string, tree_id string, x double, y double, z double")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one per file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Every ``scene.json`` below a prefix as ``path, doc VARIANT``; unreadable ones are left out."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "scene.json").option("recursiveFileLookup", "true")
             .load(path))
    text = files.select("path", F.decode("content", "UTF-8").alias("text"))
    return text.select("path", F.try_parse_json("text").alias("doc")).where("doc is not null")


def read_footprint(spark: SparkSession, path: str) -> DataFrame:
    """File listing ``path, length, modificationTime`` without contents."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select("path", "length", "modificationTime"))


def read_publish_list(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Ids listed as keys of the ``publish`` object; None means everything is published."""
    if path is None:
        return None
    doc = spark.read.text(path, wholetext=True)
    parsed = F.from_json(F.get_json_object("value", "$.publish"), "map<string,string>")
    return doc.select(F.explode(F.map_keys(parsed)).alias("id"))


def read_colmap(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Text camera model: ``cameras`` (first only), ``images``, ``points``."""
    def rows(name):
        lines = spark.read.text(f"{folder}/{name}.txt").where("value not like '#%' and trim(value) <> ''")
        return lines.select(F.split(F.trim("value"), r"\s+").alias("p"))

    def at(k, kind="double"):
        return F.try_element_at("p", F.lit(k)).try_cast(kind)

    cam = rows("cameras").select(at(1, "int").alias("camera_id"), F.col("p")[1].alias("model"), at(3, "int").alias("width"),
                                 at(4, "int").alias("height"), *[at(k).alias(n) for k, n in zip(range(5, 9), ("fx", "fy", "cx", "cy"))])
    # an image has two lines, the second of which may be empty
    lines = numbered_lines(spark, f"{folder}/images.txt", ~F.col("value").startswith("#")).where("line_no % 2 = 0")
    images = lines.select(words_of(F.col("value")).alias("p")).where(F.size("p") >= 10).select(
        at(1, "int").alias("image_id"), *[at(k).alias(n) for k, n in zip(range(2, 9), ("ew", "ex", "ey", "ez", "px", "py", "pz"))],
        at(9, "int").alias("camera_id"), F.col("p")[9].alias("name"))
    points = rows("points3D").select(at(1, "bigint").alias("point_idx"), *[at(k).alias(n) for k, n in zip(range(2, 5), "xyz")],
                                     *[at(k, "int").alias(n) for k, n in zip(range(5, 8), "rgb")])
    return {"cameras": cam.orderBy("camera_id").limit(1), "images": images, "points": points}


def write_colmap(folder: str, cameras: DataFrame, images: DataFrame, points: DataFrame) -> None:
    """Text camera model as folders of ordered part files.

    ``images``: ``image_id, ew..ez, px..pz, name``; ``points``: ``tile_id,
    point_idx, x, y, z, r, g, b`` get running ids.
    """
    cam = cameras.select(F.format_string("%d PINHOLE %d %d %.6f %.6f %.6f %.6f", "camera_id", "width", "height", "fx", "fy", "cx", "cy").alias("value"))
    cam.write.mode("overwrite").text(f"{folder}/cameras.txt")
    img = images.select("image_id", F.explode(F.array(
        F.format_string("%d %.9f %.9f %.9f %.9f %.6f %.6f %.6f 1 %s", "image_id", "ew", "ex", "ey", "ez", "px", "py", "pz", "name"), F.lit(""))).alias("value"))
    img.repartitionByRange("image_id").sortWithinPartitions("image_id", F.col("value").desc()).select("value").write.mode("overwrite").text(f"{folder}/images.txt")
    numbered = running_total(points, [], [F.col("tile_id"), F.col("point_idx")], None, "id")
    numbered.select(F.format_string("%d %.4f %.4f %.4f %d %d %d 1.0", "id", "x", "y", "z", "r", "g", "b").alias("value")).write.mode(
        "overwrite").text(f"{folder}/points3D.txt")


def read_ascii_grid(spark: SparkSession, path: str, nodata_below: float = -9990.0) -> DataFrame:
    """Raster text files to ``grid_id, row, col, x, y, value``; x and y are cell centres, nodata is null.

    Lines are split over tasks; a raster has one line per row behind its header.
    """
    lines = numbered_lines(spark, path, F.trim("value") != "")
    named = F.lower("value").rlike("^[a-z]")
    top = lines.where((F.col("line_no") < HEADER_LINES) & named).withColumn("p", words_of(F.lower("value")))
    heads = top.groupBy("file").agg((F.max("line_no") + 1).alias("_body"), *[
        F.max(F.when(F.col("p")[0] == n, F.col("p")[1].try_cast("double"))).alias(f"_{n}") for n in ("nrows", "xllcorner", "yllcorner", "cellsize")])
    rows = lines.where(~named).join(broadcast_if_small(heads), "file").select(
        stem_of(F.col("file")).alias("grid_id"), (F.col("line_no") - F.col("_body")).cast("int").alias("row"), "value", "_nrows", "_xllcorner", "_yllcorner", "_cellsize")
    cells = rows.select("*", F.posexplode(words_of(F.col("value"))).alias("col", "text"))
    value = F.col("text").try_cast("double")
    return cells.select("grid_id", "row", "col", (F.col("_xllcorner") + (F.col("col") + 0.5) * F.col("_cellsize")).alias("x"),
                        (F.col("_yllcorner") + (F.col("_nrows") - F.col("row") - 0.5) * F.col("_cellsize")).alias("y"),
                        F.when(value > nodata_below, value).alias("value"))


def write_ascii_grid(cells: DataFrame, path: str, width: int, height: int, xmin: float, ymin: float, size: float) -> None:
    """``row, col, value`` to raster text, row 0 north; part files in name order form the grid."""
    frame = cells.sparkSession.range(height).select(F.col("id").cast("int").alias("row"))
    values = cells.where(F.col("value").isNotNull()).groupBy("row").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("int"), "value"))).alias("m"))
    cell = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.coalesce(
        F.format_string("%.4f", F.try_element_at(F.col("m"), c)), F.lit("-9999.0000")))
    cell = F.when(F.col("m").isNotNull(), cell).otherwise(F.array_repeat(F.lit("-9999.0000"), width))
    lines = frame.join(values, "row", "left").select("row", F.concat_ws(" ", cell).alias("value"))
    lines = lines.withColumn("value", F.regexp_replace("value", "null", "-9999.0000"))
    header = (f"ncols {width}\nnrows {height}\nxllcorner {xmin:.3f}\nyllcorner {ymin:.3f}\ncellsize {size}\nNODATA_value -9999")
    top = cells.sparkSession.createDataFrame([(-1, header)], "row int, value string")
    out = lines.unionByName(top).repartitionByRange("row").sortWithinPartitions("row")
    out.select("value").write.mode("overwrite").text(path)


def write_inventory_csv(trees: DataFrame, path: str) -> None:
    """Stem table with the fixed column order; missing values are blank, other columns are dropped."""
    have = [F.col(c) if c in trees.columns else F.lit(None).cast("string").alias(c) for c in INVENTORY_COLUMNS]
    trees.select(*have).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_documents(docs: DataFrame, path: str, key: str) -> None:
    """JSON documents with nulls kept, partitioned by their key."""
    body = F.to_json(F.struct(*[c for c in docs.columns if c != key]), {"ignoreNullFields": "false"})
    docs.select(key, body.alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files to pixels ``image_id, row, col, r, g, b``; image_id is the file name."""
    def expand(batches):
        for batch in batches:
            for img in batch.column("image").to_pylist():
                h, w, c = img["height"], img["width"], img["nChannels"]
                data = np.frombuffer(img["data"], np.uint8).reshape(h, w, c)
                blue, green, red = (data[..., min(k, c - 1)] for k in range(3))
                name = img["origin"].rsplit("/", 1)[-1]
                step = max(1, 65_536 // w)
                for top in range(0, h, step):
                    rows = slice(top, min(top + step, h))
                    n = (rows.stop - top) * w
                    rr, cc = np.divmod(np.arange(top * w, top * w + n), w)
                    yield pa.record_batch([pa.array([name] * n), pa.array(rr.astype(np.int32)), pa.array(cc.astype(np.int32)),
                                           *[pa.array(p[rows].reshape(-1).astype(np.int32)) for p in (red, green, blue)]],
                                          names=["image_id", "row", "col", "r", "g", "b"])

    return spark.read.format("image").load(path).mapInArrow(expand, "image_id string, row int, col int, r int, g int, b int")


def write_cloud(points: DataFrame, path: str, origin: tuple[float, float, float] | None = None, layout: str = "blocks") -> None:
    """Block binary of a cloud around an origin (the centroid when not given)."""
    if origin is None:
        origin = tuple(points.agg(*[F.avg(a) for a in "xyz"]).first())
    cols = ["x", "y", "z", "r", "g", "b"] + (["seg_id"] if layout == "segmented" else [])
    points.select(*cols).write.format("cloudbin").option("layout", layout).option("origin", ",".join(repr(float(v)) for v in origin)).mode(
        "append").save(path)


def write_las(points: DataFrame, path: str) -> None:
    """LAS with the common offset at the lowest corner; colours are widened and intensities stretched to 16 bit."""
    from canopyframe.operators.colour import colour_16bit, minmax_rescale
    out = points
    if "intensity" in out.columns:
        out = minmax_rescale(out, "intensity", "intensity")
    if "r" in out.columns and "red" not in out.columns:
        out = colour_16bit(out.withColumnsRenamed({"r": "red", "g": "green", "b": "blue"}), ["red", "green", "blue"])
    low = points.agg(*[F.min(a) for a in "xyz"]).first()
    keep = [c for c in ("x", "y", "z", "intensity", "class", "source_id", "red", "green", "blue") if c in out.columns]
    out.select(*keep).write.format("las").option("offset", ",".join(repr(float(v)) for v in low)).mode("append").save(path)


def write_ply(splats: DataFrame, path: str) -> None:
    splats.write.format("plyvertex").mode("append").save(path)


def write_levels(levels: DataFrame, path: str, names: list[str], origin: tuple[float, float, float]) -> DataFrame:
    """One block binary per density level; returns their manifest rows, the first level being the default."""
    for name in names:
        write_cloud(levels.where(F.col("level") == name), f"{path}/{name}", origin)
    rows = levels.groupBy("level").agg(F.count(F.lit(1)).alias("count"), *[f(a).alias(f"{n}_{a}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))])
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("level"))
    return rows.withColumn("level_no", order.cast("int")).withColumn("bin", F.concat(F.lit(f"{path}/"), "level"))
