"""Text files as numbered lines, read by as many tasks as their size asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopyframe.runtime import broadcast_if_small

#: Lines at the start of a file that may belong to its header.
HEADER_LINES = 64


def numbered_lines(spark: SparkSession, path: str, keep: Column | None = None, glob: str | None = None) -> DataFrame:
    """``file, line_no, value``: lines of each file counted from 0, over those that ``keep`` holds for.

    Spark splits large files by byte ranges at line ends. Lines are numbered within
    their range; the ranges of a file, a few rows, give the numbers to begin with. The
    files are read twice, once for the counts.
    """
    reader = spark.read if glob is None else spark.read.option("pathGlobFilter", glob)
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"))
    if keep is not None:
        lines = lines.where(keep)
    # a range is read by one task in one go, so these numbers have no gaps in it
    lines = lines.withColumn("_seq", F.monotonically_increasing_id())
    ranges = lines.groupBy("file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("file", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_move"))
    return lines.join(broadcast_if_small(offsets), ["file", "_start"]).select("file", (F.col("_seq") + F.col("_move")).alias("line_no"), "value")


def stem_of(file: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_extract(file, r"([^/]+?)(?:\.[^./]*)?$", 1)


def words_of(value: Column) -> Column:
    return F.split(F.trim(value), r"\s+")


def read_point_labels(spark: SparkSession, path: str) -> DataFrame:
    """One integer per line, aligned with the rows of the cloud of the same name: ``tile_id, point_idx, label``."""
    lines = numbered_lines(spark, path, F.trim("value") != "")
    return lines.select(stem_of(F.col("file")).alias("tile_id"), F.col("line_no").alias("point_idx"), F.trim("value").cast("double").cast("bigint").alias("label"))


def read_pcd_text(spark: SparkSession, path: str) -> DataFrame:
    """PCD files with text data: ``tile_id, point_idx, x, y, z, r, g, b``; coordinates in single precision, colour if there is one."""
    lines = numbered_lines(spark, path, (F.trim("value") != "") & ~F.col("value").startswith("#"), "*.pcd")
    top = lines.where(F.col("line_no") < HEADER_LINES)
    said = lambda name: F.max(F.when(F.upper("value").startswith(name + " "), words_of(F.col("value"))))
    heads = top.groupBy("file").agg(F.max(F.when(F.upper("value").rlike(r"^DATA\s+ASCII"), F.col("line_no"))).alias("_data"), said("FIELDS").alias("_fields"), said("COUNT").alias("_count"))
    names = F.slice("_fields", F.lit(2), F.size("_fields") - 1)
    counts = F.transform(F.slice("_count", F.lit(2), F.size("_count") - 1), lambda c: c.cast("int"))
    wide = F.when(F.col("_count").isNull(), names).otherwise(F.flatten(F.zip_with(names, counts, lambda n, c: F.array_repeat(n, c))))
    heads = heads.where(F.col("_data").isNotNull()).select("file", "_data", wide.alias("_names"))
    rows = lines.join(broadcast_if_small(heads), "file").where(F.col("line_no") > F.col("_data")).withColumn("_words", words_of(F.col("value")))

    def field(*options: str) -> Column:
        place = F.coalesce(*[F.nullif(F.array_position("_names", n), F.lit(0)) for n in options])
        return F.try_element_at("_words", place.cast("int"))

    bits = F.floor(field("rgb", "rgba").cast("double")).cast("bigint")
    channel = lambda shift: F.shiftright(bits, shift).bitwiseAND(F.lit(255)).cast("smallint")
    return rows.select(stem_of(F.col("file")).alias("tile_id"), (F.col("line_no") - F.col("_data") - 1).alias("point_idx"),
                       *[field(a).cast("float").cast("double").alias(a) for a in "xyz"], *[channel(s).alias(c) for c, s in (("r", 16), ("g", 8), ("b", 0))])
