"""Context of a place: relief, raster samples, mapped features, soil, and the combined record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.functions.geometry import slope_aspect
from canopyframe.runtime import salted_join
from canopyframe.spatial import range_join


def relief(cells: DataFrame, step: float = 30.0) -> DataFrame:
    """Slope and aspect of every raster cell with four valid neighbours.

    Each cell sends its value to its neighbours, so one shuffle gathers them.
    """
    moves = (("north", 0, -1), ("south", 0, 1), ("east", -1, 0), ("west", 1, 0), ("here", 0, 0))
    sends = F.array(*[F.struct(F.lit(n).alias("role"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for n, dx, dy in moves])
    out = cells.where(F.col("value").isNotNull()).withColumn("_s", F.explode(sends)).select(
        (F.col("cx") + F.col("_s.dx")).alias("cx"), (F.col("cy") + F.col("_s.dy")).alias("cy"), F.col("_s.role").alias("role"), "value")
    near = out.groupBy("cx", "cy").agg(*[F.max(F.when(F.col("role") == n, F.col("value"))).alias(n) for n, _, _ in moves])
    full = near.where(" and ".join(f"{n} is not null" for n, _, _ in moves))
    slope, ref, compass = slope_aspect(F.col("north"), F.col("south"), F.col("east"), F.col("west"), step)
    return full.select("cx", "cy", F.col("here").alias("elevation_m"), slope.alias("slope_deg"), ref.alias("aspect_ref_deg"),
                       compass.alias("aspect_compass_deg"))


def raster_sample(places: DataFrame, cells: DataFrame, size: float, x0: float, y0: float, width: int, height: int) -> DataFrame:
    """Raster value at each place: adds ``value`` and ``error`` for places off the raster.

    Row 0 is at ``y0`` (the top edge); ``cells`` has ``row, col, value`` with null for nodata.
    """
    keyed = places.withColumn("col", F.floor((F.col("x") - x0) / size)).withColumn("row", F.floor((F.lit(y0) - F.col("y")) / size))
    inside = F.col("col").between(0, width - 1) & F.col("row").between(0, height - 1)
    out = salted_join(keyed, cells.select("row", "col", "value"), ["row", "col"], "left")
    return out.withColumn("error", F.when(~inside, F.lit("outside raster"))).withColumn(
        "value", F.when(inside, F.col("value"))).drop("row", "col")


def tile_plan(extents: DataFrame, res: float, max_px: int = 2000) -> DataFrame:
    """Requests that cover each extent with tiles of at most ``max_px`` pixels, north up."""
    w, h = F.rint((F.col("xmax") - F.col("xmin")) / res).cast("int"), F.rint((F.col("ymax") - F.col("ymin")) / res).cast("int")
    out = extents.withColumn("_w", w).withColumn("_h", h)
    n = lambda c: F.ceil(F.col(c) / F.lit(float(max_px))).cast("int")
    out = out.withColumn("tile_x", F.explode(F.sequence(F.lit(0), n("_w") - 1))).withColumn(
        "tile_y", F.explode(F.sequence(F.lit(0), n("_h") - 1)))
    x0, y0 = F.col("tile_x") * max_px, F.col("tile_y") * max_px
    x1, y1 = F.least(x0 + max_px, F.col("_w")), F.least(y0 + max_px, F.col("_h"))
    return out.select(*extents.columns, "tile_x", "tile_y", (x1 - x0).alias("width"), (y1 - y0).alias("height"),
                      (F.col("xmin") + x0 * res).alias("tile_xmin"), (F.col("ymax") - y1 * res).alias("tile_ymin"),
                      (F.col("xmin") + x1 * res).alias("tile_xmax"), (F.col("ymax") - y0 * res).alias("tile_ymax"))


def map_context(places: DataFrame, elements: DataFrame, radius: float) -> DataFrame:
    """First forest and first protected area, in element order, within a radius of each place.

    ``places``: ``place_id, x, y`` in metres; ``elements``: ``pos, ex, ey, tags map``.
    """
    tag = lambda k: F.try_element_at(F.col("tags"), F.lit(k))
    protected = F.coalesce(tag("boundary") == "protected_area", F.lit(False))
    forest = F.coalesce(tag("landuse") == "forest", F.lit(False)) | F.coalesce(tag("natural") == "wood", F.lit(False))
    slim = elements.select("pos", "ex", "ey", protected.alias("is_protected"), (forest & ~protected).alias("is_forest"),
                           F.coalesce(tag("landuse"), F.when(tag("natural").isNotNull(), "wood")).alias("landuse"),
                           tag("leaf_type").alias("leaf_type"), tag("name").alias("name"),
                           F.coalesce(tag("name"), tag("protection_title"), F.lit("yes")).alias("area"))
    # of the elements at one position only the first of each kind counts, and places at one position have the same context
    spots = slim.where("is_protected or is_forest").groupBy("ex", "ey").agg(
        F.min(F.when(F.col("is_forest"), F.struct("pos", "landuse", "leaf_type", "name"))).alias("f"),
        F.min(F.when(F.col("is_protected"), F.struct("pos", "area"))).alias("p"))
    near = range_join(spots, places.select("x", "y").distinct(), radius, ("ex", "ey"), ("x", "y"))
    by_spot = near.groupBy("x", "y").agg(F.min("f").alias("f"), F.min("p").alias("p"))
    found = salted_join(places.select("place_id", "x", "y"), by_spot, ["x", "y"]).groupBy("place_id").agg(
        F.min("f").alias("f"), F.min("p").alias("p"))
    return places.select("place_id").join(found, "place_id", "left").select(
        "place_id", F.col("f.landuse").alias("landuse"), F.col("f.leaf_type").alias("leaf_type"), F.col("f.name").alias("name"),
        F.col("p.area").alias("protected_area"))


SOIL_SCHEMA = ("struct<properties:struct<layers:array<struct<name:string,unit_measure:struct<d_factor:double,target_units:string>,"
               "depths:array<struct<values:struct<mean:double>>>>>>>")


def soil_layers(responses: DataFrame) -> DataFrame:
    """Saved soil service responses (``place_id, body``) to one row per property."""
    parsed = responses.withColumn("d", F.from_json("body", SOIL_SCHEMA))
    rows = parsed.select("place_id", F.explode("d.properties.layers").alias("l"))
    factor = F.coalesce(F.nullif(F.col("l.unit_measure.d_factor"), F.lit(0.0)), F.lit(1.0))
    return rows.select("place_id", F.col("l.name").alias("property"),
                       F.round(F.try_element_at("l.depths", F.lit(1))["values"]["mean"] / factor, 2).alias("value"),
                       F.coalesce("l.unit_measure.target_units", F.lit("")).alias("units"))


def elevation_points(responses: DataFrame) -> DataFrame:
    """Saved elevation responses (``place_id, body``) to ``place_id, pos, elevation_m``."""
    parsed = responses.withColumn("d", F.from_json("body", "struct<results:array<struct<elevation:double>>>"))
    return parsed.select("place_id", F.posexplode("d.results").alias("pos", "r")).select("place_id", "pos", F.col("r.elevation").alias("elevation_m"))


def map_elements(responses: DataFrame) -> DataFrame:
    """Saved map feature responses (``place_id, body``) to ``place_id, pos, lat, lon, tags``."""
    schema = ("struct<elements:array<struct<lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>>")
    parsed = responses.withColumn("d", F.from_json("body", schema))
    return parsed.select("place_id", F.posexplode("d.elements").alias("pos", "e")).select(
        "place_id", "pos", F.coalesce("e.center.lat", "e.lat").alias("lat"), F.coalesce("e.center.lon", "e.lon").alias("lon"), F.col("e.tags").alias("tags"))


def provenance_record(places: DataFrame, sources: dict[str, DataFrame], image: DataFrame | None = None) -> DataFrame:
    """Four-level record per place: observed, image derived, enriched by position, measured.

    Every source is joined on its own; a place a source knows nothing about gets
    an ``error`` in that block and keeps the other blocks.
    """
    out = places
    blocks = []
    for name, df in sources.items():
        fields = [c for c in df.columns if c != "place_id"]
        packed = df.select("place_id", F.struct(*fields).alias(f"_{name}"))
        out = out.join(packed, "place_id", "left")
        missing = F.col(f"_{name}").isNull()
        blocks.append(F.struct(F.when(missing, F.lit("no data")).alias("error"), *[F.col(f"_{name}.{f}").alias(f) for f in fields]).alias(name))
    has_place = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    enriched = F.when(has_place, F.struct(*blocks)).alias("geo_enriched")
    if image is not None:
        fields = [c for c in image.columns if c != "place_id"]
        out = out.join(image.select("place_id", F.struct(*fields).alias("_image")), "place_id", "left")
        derived: Column = F.col("_image")
    else:
        derived = F.lit(None).cast("string")
    measured = F.struct(*[F.lit(None).cast("double").alias(n) for n in
                          ("dbh_cm", "height_m", "basal_area_m2_ha", "volume_m3_ha", "stand_age_a")])
    return out.select("place_id", F.struct("provider", "license", "image_url").alias("source"),
                      F.struct("lon", "lat", "coord_precision_m", "coord_source").alias("geometry"),
                      derived.alias("image_derived"), enriched, measured.alias("measured_inventory"))
