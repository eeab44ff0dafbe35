"""Tree lists, tabular growth projection and its way back into the markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe import dims
from canopyframe.operators.statistics import numeric


def species_code(df: DataFrame, name: str = "species_name", default: int = 511, out: str = "species_code") -> DataFrame:
    """Code of a species name, synonym or numeric text; the default where unknown."""
    codes = F.broadcast(dims.species_codes(df.sparkSession))  # fixed table of 20 rows
    key = F.lower(F.trim(F.col(name)))
    joined = df.withColumn("_key", key).join(codes.withColumnsRenamed({"species_key": "_key", "species_code": "_code"}), "_key", "left")
    digits = F.when(F.col("_key").rlike("^[0-9]+$"), F.col("_key").try_cast("int"))
    return joined.withColumn(out, F.coalesce(digits, F.col("_code"), F.lit(default))).drop("_key", "_code")


def tree_list(rows: DataFrame, source: str, default: int = 511) -> DataFrame:
    """One schema from three inventory shapes; rows without diameter or height are kept and flagged.

    ``markers``: ``id, attributes map, xyz array, origin array``. ``csv``: text
    columns named by either spelling plus ``row_no``. ``stand``: ``id,
    attributes map, world array`` with a y-up world.
    Output ``tree_id, species_code, dbh_cm, height_m, x, y, crown_base_m,
    age_years, species_conf, skipped``.
    """
    if source == "csv":
        def get(*names):
            have = [F.nullif(F.col(n), F.lit("")) for n in names if n in rows.columns]
            return F.coalesce(*have) if have else F.lit(None).cast("string")
        ident = F.coalesce(get("label"), get("id"), F.format_string("t%03d", F.col("row_no")))
        x, y = numeric(get("x")), numeric(get("y"))
    else:
        def get(*names):
            return F.coalesce(*[F.nullif(F.try_element_at(F.col("attributes"), F.lit(n)), F.lit("")) for n in names])
        ident = F.col("id")
        if source == "markers":
            x = F.try_element_at("xyz", F.lit(1)) - F.try_element_at("origin", F.lit(1))
            y = F.try_element_at("xyz", F.lit(2)) - F.try_element_at("origin", F.lit(2))
        else:
            x, y = F.try_element_at("world", F.lit(1)), -F.try_element_at("world", F.lit(3))
    picked = rows.select(
        ident.alias("tree_id"), get("species", "species_name").alias("_species"), numeric(get("dbh_cm")).alias("dbh_cm"),
        numeric(get("height_m")).alias("height_m"), x.alias("x"), y.alias("y"), numeric(get("crown_base_m")).alias("crown_base_m"),
        numeric(get("age_years")).alias("age_years"), numeric(get("species_conf")).alias("species_conf"))
    coded = species_code(picked, "_species", default).drop("_species")
    return coded.withColumn("skipped", F.col("dbh_cm").isNull() | F.col("height_m").isNull())


def skipped_counts(trees: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Usable and skipped rows."""
    return trees.groupBy(*(keys or [])).agg(F.count_if(~F.col("skipped")).alias("n_trees"), F.count_if(F.col("skipped")).alias("n_skipped"))


def stand_settings(config: DataFrame, given: DataFrame) -> DataFrame:
    """Stand record: file values win over given ones; flags whether age and site index are known."""
    fields = [c for c in given.columns if c != "stand_id"]
    conf = config.select("stand_id", *[F.col(c).alias(f"_c_{c}") for c in fields if c in config.columns])
    out = given.join(conf, "stand_id", "left")
    for c in fields:
        if c in config.columns:
            out = out.withColumn(c, F.coalesce(f"_c_{c}", c)).drop(f"_c_{c}")
    return out.withColumn("complete", F.col("age_years").isNotNull() & F.col("site_index").isNotNull())


def growth_request(stands: DataFrame, trees: DataFrame, years: int | None = None, step: int = 5,
                   part_rows: int = 1000) -> DataFrame:
    """JSON requests per stand, in parts of ``part_rows`` trees: ``stand_id, part, request``."""
    fields = [c for c in trees.columns if c not in ("stand_id", "skipped", "pos")]
    usable = trees.where(~F.col("skipped")).withColumn("part", F.floor(F.col("pos") / part_rows).cast("int"))
    docs = usable.groupBy("stand_id", "part").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("t")))), lambda e: e["t"]).alias("trees"))
    settings = F.struct(*[c for c in stands.columns if c != "complete"])
    body = {"stand": settings, "trees": F.col("trees")}
    if years:
        body["simulate"] = F.struct(F.lit(years).alias("years"), F.lit(step).alias("step_years"))
    return docs.join(stands, "stand_id").select(
        "stand_id", "part", F.to_json(F.struct(*[v.alias(k) for k, v in body.items()])).alias("request"))


def project_growth(trees: DataFrame, years: int = 20, step: int = 5, base_year: int = 2024) -> DataFrame:
    """Linear projection per tree and period; thin trees leave after 15 years.

    Missing diameters and heights count as 0. Adds ``year, age_step, dbh_cm,
    height_m, alive, removed``.
    """
    rates = F.broadcast(dims.growth_rates(trees.sparkSession))  # fixed table of 8 rows
    dbh0, h0 = F.coalesce("dbh_cm", F.lit(0.0)), F.coalesce("height_m", F.lit(0.0))
    joined = trees.join(rates, "species_code", "left")
    grown = joined.withColumn("age_step", F.explode(F.sequence(F.lit(0), F.lit(years), F.lit(step))))
    alive = ~((dbh0 < 10) & (F.col("age_step") >= 15))
    return grown.withColumns({
        "year": F.col("age_step") + base_year, "alive": alive, "removed": ~alive,
        "dbh_cm": dbh0 + F.coalesce("dbh_rate", F.lit(dims.DEFAULT_RATE[0])) * F.col("age_step"),
        "height_m": h0 + F.coalesce("height_rate", F.lit(dims.DEFAULT_RATE[1])) * F.col("age_step"),
    }).drop("dbh_rate", "height_rate")


def projection_summary(projection: DataFrame, area_ha: float, keys: list[str]) -> DataFrame:
    """Living trees per period: number, means, stems and basal area per hectare."""
    area = F.lit(float(area_ha))
    return projection.where("alive").groupBy(*keys, "year").agg(
        F.count(F.lit(1)).alias("n_alive"), F.avg("dbh_cm").alias("dbh_mean_cm"), F.avg("height_m").alias("height_mean_m"),
        (F.count(F.lit(1)) / area).alias("stems_per_ha"),
        (F.sum(F.lit(3.141592653589793) * F.col("dbh_cm") * F.col("dbh_cm") / 40000) / area).alias("basal_area_m2_ha"))


def pick_period(periods: DataFrame, keys: list[str], target: Column | int | None, pos: str = "pos") -> DataFrame:
    """The period of the target year, else the nearest (first of equals); the last without a target."""
    if target is None:
        order = F.struct(-F.col(pos))
    else:
        target = F.lit(target) if isinstance(target, int) else target
        order = F.struct(F.abs(F.col("year") - target), F.col(pos))
    return periods.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in periods.columns if c not in keys]), order).alias("p")).select(
        *keys, "p.*")


def apply_projection(markers: DataFrame, projection: DataFrame, attach: bool = False, drop_removed: bool = False) -> DataFrame:
    """Write one projected period into the markers.

    ``projection``: ``marker_key, year, dbh_cm, height_m, alive, removed``.
    Without ``attach`` the values replace the marker's own; with it they go
    into a ``prognosis`` struct. Removed trees can be dropped, except when
    attaching. Markers without a projection stay as they are.
    """
    side = projection.select("marker_key", F.col("year").alias("_year"), F.col("dbh_cm").alias("_dbh"), F.col("height_m").alias("_h"),
                             (F.coalesce("removed", F.lit(False)) | (F.coalesce("alive", F.lit(True)) == F.lit(False))).alias("_gone"))
    out = markers.join(side, "marker_key", "left")
    hit = F.col("_gone").isNotNull()
    if attach:
        block = F.struct(F.col("_year").alias("year"), F.col("_dbh").alias("dbh_cm"), F.col("_h").alias("height_m"),
                         F.when(F.col("_gone"), "removed").otherwise("standing").alias("status"))
        return out.withColumn("prognosis", F.when(hit, block)).drop("_year", "_dbh", "_h", "_gone")
    if drop_removed:
        out = out.where(~F.coalesce("_gone", F.lit(False)))
    return (out.withColumn("dbh_cm", F.coalesce("_dbh", "dbh_cm")).withColumn("height_m", F.coalesce("_h", "height_m"))
            .withColumn("status", F.when(F.col("_gone"), "removed")).withColumn("prognosis_year", F.col("_year"))
            .drop("_year", "_dbh", "_h", "_gone"))
