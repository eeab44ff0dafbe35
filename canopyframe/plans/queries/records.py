"""Queries on measurements, tree lists, manifests, jobs, cylinders, splats and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyframe import dims
from canopyframe.functions import geometry, species
from canopyframe.operators import cylinders as cyl
from canopyframe.operators import growth, jobs, learning, scenes
from canopyframe.operators import pixels as px
from canopyframe.operators import statistics as st
from canopyframe.plans.catalog import register
from canopyframe.ranking import running_total

# ---- measurements -----------------------------------------------------------------

Z_SQL = """med as (select median(green_share) as ml, median(structure) as mr from measurements),
  mad as (select median(abs(green_share - ml)) as dl, median(abs(structure - mr)) as dr from measurements, med),
  z as (select m.*, (green_share - ml)/(1.4826e0*coalesce(nullif(dl, 0), 1e-6)) as left_z, (structure - mr)/(1.4826e0*coalesce(nullif(dr, 0), 1e-6)) as right_z
    from measurements m, med, mad),
  v as (select *, case when left_z <= -1 and right_z <= -1 then 'damage confirmed' when left_z >= 1 and right_z >= 1 then 'vital confirmed'
    when left_z <= -1 and right_z >= 1 then 'contradiction: stress without structural loss'
    when left_z >= 1 and right_z <= -1 then 'contradiction: sparse structure, green image' else 'normal' end as verdict from z)"""


def _checked(src):
    m = src("measurements")
    return st.cross_check(m.select("marker_id", F.col("green_share").alias("left_value"), F.col("structure").alias("right_value")))


@register("robust_z", "marker_id:i z:6", f"with {Z_SQL} select marker_id, left_z as z from z", "measurements")
def _(src):
    return st.robust_z(src("measurements"), "green_share", "z")


@register("robust_z_per_stand", "tree_id:i z:6",
          """with m as (select stand_id, median(dbh_cm) as md from trees group by 1),
             d as (select stand_id, median(abs(dbh_cm - md)) as mad from trees join m using (stand_id) group by 1)
             select tree_id, (dbh_cm - md)/(1.4826e0*coalesce(nullif(mad, 0), 1e-6)) as z from trees join m using (stand_id) join d using (stand_id)""", "trees")
def _(src):
    return st.robust_z(src("trees"), "dbh_cm", "z", ["stand_id"])


@register("vitality_class", "marker_id:i vitality",
          f"with {Z_SQL} select marker_id, case when left_z <= -1.5 then 'conspicuous' when left_z >= 1 then 'vital' else 'normal' end as vitality from z",
          "measurements")
def _(src):
    return st.robust_z(src("measurements"), "green_share", "z").select("marker_id", st.vitality_class(F.col("z")).alias("vitality"))


@register("spearman", "rho:8 n_pairs:i",
          """with r as (select rank() over (order by n_views) + (count(*) over (partition by n_views) - 1)/2e0 as ra,
               rank() over (order by structure) + (count(*) over (partition by structure) - 1)/2e0 as rb from measurements)
             select corr(ra, rb) as rho, count(*) as n_pairs from r""", "measurements")
def _(src):
    return st.spearman(src("measurements"), "n_views", "structure")


@register("pair_measurements", "marker_id:i left_value:9 right_value:4",
          """with l as (select marker_id, arg_max(green_share, view_id) as left_value from views where green_share is not null group by 1),
             r as (select c_custkey as marker_id, -c_acctbal as right_value from customer where c_acctbal is not null and c_custkey % 7 > 0)
             select marker_id, left_value, right_value from l join r using (marker_id)""", "views trees")
def _(src):
    right = src("accounts")
    return st.pair_measurements(src("views").withColumnRenamed("view_id", "row_idx"), right, "green_share", "structure", invert=True)


@register("cross_verdict", "marker_id:i left_z:6 right_z:6 verdict", f"with {Z_SQL} select marker_id, left_z, right_z, verdict from v", "measurements")
def _(src):
    return _checked(src)


@register("verdict_counts", "agree:i contradict:i neutral:i",
          f"""with {Z_SQL} select count(*) filter (where verdict like '%confirmed') as agree, count(*) filter (where verdict like 'contradiction%') as contradict,
                count(*) filter (where verdict = 'normal') as neutral from v""", "measurements")
def _(src):
    return st.verdict_counts(_checked(src))


@register("verdict_order", "marker_id:i left_z:6 verdict",
          f"with {Z_SQL} select marker_id, left_z, verdict from v order by case when verdict like 'contradiction%' then 0 else 1 end, left_z, marker_id",
          "measurements")
def _(src):
    return st.verdict_order(_checked(src))


@register("species_composition", "species_name n:i pct:i",
          """select species_name, count(*) as n, round_even(count(*)*100e0/sum(count(*)) over (), 0) as pct from trees where species_name is not null group by 1""",
          "trees")
def _(src):
    return st.composition(src("trees"), "species_name")


@register("tolerant_cast", "event_id:i number:6",
          """select event_id, case when regexp_matches(t, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') then cast(t as double) end as number
             from (select event_id, case event_id % 5 when 0 then '' when 1 then cast(duration_s as varchar) when 2 then concat(cast(event_id as varchar), 'd')
               when 3 then concat('1_', cast(event_id as varchar)) else concat('-', cast(event_id as varchar), '.5') end as t from job_events)""", "job_events")
def _(src):
    e = F.col("event_id")
    text = (F.when(e % 5 == 0, "").when(e % 5 == 1, F.col("duration_s").cast("string")).when(e % 5 == 2, F.concat(e.cast("string"), F.lit("d")))
            .when(e % 5 == 3, F.concat(F.lit("1_"), e.cast("string"))).otherwise(F.concat(F.lit("-"), e.cast("string"), F.lit(".5"))))
    return src("job_events").select("event_id", st.numeric(text).alias("number"))


# ---- tree lists and growth ----------------------------------------------------------

SPECIES_VALUES = ", ".join(f"('{k}', {v})" for k, v in dims.SPECIES_CODES.items())
RATE_VALUES = ", ".join(f"({k}, {d}e0, {h}e0)" for k, (d, h) in dims.GROWTH_RATES.items())
_NAMES = ["  Fichte ", "FAGUS sylvatica", "611", "unknown", "Larix", "711 "]
_NAME_SQL = "case tree_id % 7 " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(_NAMES)) + " end"
TREELIST_SQL = f"""sp as (select * from (values {SPECIES_VALUES}) as t(k, code)),
  tl as (select tree_id, stand_id, dbh_cm, height_m, x, y, coalesce(case when regexp_matches(trim(nm), '^[0-9]+$') then cast(trim(nm) as int) end, sp.code, 511) as species_code
    from (select *, {_NAME_SQL} as nm from trees) t left join sp on sp.k = lower(trim(nm)))"""


def _named_trees(src):
    name = F.col("tree_id") % 7
    col = F.when(name == 0, _NAMES[0])
    for i, n in enumerate(_NAMES[1:], 1):
        col = col.when(name == i, n)
    return src("trees").withColumn("species_text", col)


def _tree_list(src):
    rows = _named_trees(src).select(
        F.col("tree_id").cast("string").alias("label"), F.col("species_text").alias("species"), F.col("dbh_cm").cast("string").alias("dbh_cm"),
        F.coalesce(F.col("height_m").cast("string"), F.lit("")).alias("height_m"), F.col("x").cast("string").alias("x"),
        F.col("y").cast("string").alias("y"), F.col("tree_id").alias("row_no"))
    return growth.tree_list(rows, "csv").withColumn("tree_id", F.col("tree_id").cast("bigint"))


@register("species_code", "tree_id:i species_code:i", f"with {TREELIST_SQL} select tree_id, species_code from tl", "trees")
def _(src):
    return growth.species_code(_named_trees(src), "species_text")


@register("species_names", "tree_id:i common_name training_species",
          """select tree_id, case tree_id % 4 when 0 then 'sessile oak' when 1 then 'European beech' when 2 then 'Scots pine' else 'Xyz' end as common_name,
               case tree_id % 10 when 6 then 'spruce' when 7 then 'birch' when 8 then 'pine' end as training_species from trees""", "trees")
def _(src):
    t = F.col("tree_id")
    short = F.when(t % 4 == 0, "QuePet").when(t % 4 == 1, "FagSyl").when(t % 4 == 2, "PinSyl").otherwise("Xyz")
    return src("trees").select("tree_id", species.species_of_tree_key(F.concat(short, F.lit("_BR01_01"))).alias("common_name"),
                               species.species_of_category((t % 10).cast("int")).alias("training_species"))


@register("treelist_export", "tree_id:i species_code:i dbh_cm:4 height_m:4 x:4 y:4",
          f"with {TREELIST_SQL} select tree_id, species_code, dbh_cm, height_m, x, y from tl where height_m is not null", "trees")
def _(src):
    return _tree_list(src).where("not skipped")


@register("treelist_from_markers", "marker_key:i dbh_cm:4 height_m:4 x:6 y:6 skipped:b",
          """select marker_key, dbh_cm, height_m, dx - 3 as x, dy - 4 as y, height_m is null as skipped from markers""", "markers")
def _(src):
    rows = src("markers").select(
        F.col("marker_key").cast("string").alias("id"),
        F.map_filter(F.create_map(F.lit("dbh_cm"), F.col("dbh_cm").cast("string"), F.lit("height_m"), F.col("height_m").cast("string")),
                     lambda k, v: v.isNotNull()).alias("attributes"),
        F.array("dx", "dy", "dz").alias("xyz"), F.array(F.lit(3.0), F.lit(4.0), F.lit(0.0)).alias("origin"))
    return growth.tree_list(rows, "markers").withColumn("marker_key", F.col("tree_id").cast("bigint"))


@register("treelist_from_stand", "marker_key:i dbh_cm:4 height_m:4 x:6 y:6",
          "select marker_key, dbh_cm, height_m, dx as x, -dz as y from markers where height_m is not null", "markers")
def _(src):
    rows = src("markers").select(
        F.col("marker_key").cast("string").alias("id"),
        F.map_filter(F.create_map(F.lit("dbh_cm"), F.col("dbh_cm").cast("string"), F.lit("height_m"), F.col("height_m").cast("string")),
                     lambda k, v: v.isNotNull()).alias("attributes"), F.array("dx", "dy", "dz").alias("world"))
    return growth.tree_list(rows, "stand").where("not skipped").withColumn("marker_key", F.col("tree_id").cast("bigint"))


@register("treelist_skipped", "n_trees:i n_skipped:i",
          "select count(height_m) as n_trees, count(*) - count(height_m) as n_skipped from trees", "trees")
def _(src):
    return growth.skipped_counts(_tree_list(src))


@register("growth_request", "stand_id:i part:i n_trees:i sum_dbh:4",
          """with n as (select *, row_number() over (partition by stand_id order by tree_id) - 1 as pos from trees)
             select stand_id, pos // 20 as part, count(*) as n_trees, sum(dbh_cm) as sum_dbh from n where height_m is not null group by 1, 2""", "trees")
def _(src):
    listed = _tree_list(src).join(src("trees").select("tree_id", "stand_id"), "tree_id")
    listed = running_total(listed, ["stand_id"], [F.col("tree_id")], None, "no").withColumn("pos", F.col("no") - 1).drop("no")
    stands = src("trees").select("stand_id").distinct().withColumn("area_ha", F.lit(0.25))
    req = growth.growth_request(stands, listed, 20, part_rows=20)
    body = F.from_json("request", "trees array<struct<dbh_cm:double>>")
    return req.select("stand_id", "part", F.size(body["trees"]).alias("n_trees"),
                      F.aggregate(body["trees"], F.lit(0.0), lambda a, t: a + t["dbh_cm"]).alias("sum_dbh"))


@register("stand_settings", "stand_id:i area_ha:4 age_years:i site_index:3 complete:b",
          """with g as (select n_nationkey as stand_id, 0.25e0 as area_ha, case when n_nationkey % 3 = 0 then null else 60 end as age_years,
               case when n_nationkey % 4 = 0 then null else 24e0 end as site_index from nation),
             c as (select n_nationkey as stand_id, 1e0 + n_regionkey as area_ha, case when n_nationkey % 2 = 0 then 80 end as age_years from nation where n_nationkey % 5 > 0)
             select g.stand_id, coalesce(c.area_ha, g.area_ha) as area_ha, coalesce(c.age_years, g.age_years) as age_years, g.site_index,
               coalesce(c.age_years, g.age_years) is not null and g.site_index is not null as complete from g left join c using (stand_id)""", "cameras")
def _(src):
    n = src("cameras").select(F.col("camera_id").alias("stand_id"), (F.col("tx") / 4.0).alias("region"))
    given = n.select("stand_id", F.lit(0.25).alias("area_ha"), F.when(F.col("stand_id") % 3 != 0, 60).alias("age_years"),
                     F.when(F.col("stand_id") % 4 != 0, 24.0).alias("site_index"))
    config = n.where("stand_id % 5 > 0").select("stand_id", (F.col("region") + 1.0).alias("area_ha"), F.when(F.col("stand_id") % 2 == 0, 80).alias("age_years"))
    return growth.stand_settings(config, given)


GROW_SQL = TREELIST_SQL + f""", rt as (select * from (values {RATE_VALUES}) as t(code, rd, rh)),
  pr as (select tree_id, stand_id, dbh_cm as dbh0, 2024 + s as year, s as age_step, coalesce(dbh_cm, 0) + coalesce(rd, 0.35e0)*s as dbh_cm,
    coalesce(height_m, 0) + coalesce(rh, 0.18e0)*s as height_m, not (coalesce(dbh_cm, 0) < 10 and s >= 15) as alive
    from (select *, unnest([0, 5, 10, 15, 20]) as s from tl) t left join rt on rt.code = t.species_code)"""


def _projection(src):
    listed = growth.species_code(_named_trees(src), "species_text").select("tree_id", "stand_id", "species_code", "dbh_cm", "height_m")
    return growth.project_growth(listed)


@register("project_growth", "tree_id:i year:i dbh_cm:4 height_m:4 alive:b removed:b",
          f"with {GROW_SQL} select tree_id, year, dbh_cm, height_m, alive, not alive as removed from pr", "trees")
def _(src):
    return _projection(src)


@register("projection_summary", "stand_id:i year:i n_alive:i dbh_mean_cm:5 height_mean_m:5 stems_per_ha:3 basal_area_m2_ha:5",
          f"""with {GROW_SQL} select stand_id, year, count(*) as n_alive, avg(dbh_cm) as dbh_mean_cm, avg(height_m) as height_mean_m,
                count(*)/0.25e0 as stems_per_ha, sum(pi()*dbh_cm*dbh_cm/40000)/0.25e0 as basal_area_m2_ha from pr where alive group by 1, 2""", "trees")
def _(src):
    return growth.projection_summary(_projection(src), 0.25, ["stand_id"])


@register("pick_period", "tree_id:i year:i dbh_cm:4",
          f"""with {GROW_SQL} select tree_id, year, dbh_cm from (select *, row_number() over (partition by tree_id order by abs(year - (2024 + tree_id % 23)), age_step) as rn from pr)
              where rn = 1""", "trees")
def _(src):
    p = _projection(src).select("tree_id", "year", "dbh_cm", F.col("age_step").alias("pos"))
    return growth.pick_period(p, ["tree_id"], F.col("tree_id") % 23 + 2024)


@register("apply_projection", "marker_key:i dbh_cm:4 height_m:4 status prognosis_year:i",
          f"""with {GROW_SQL}, p as (select tree_id as marker_key, year, dbh_cm, height_m, alive from pr where year = 2044)
              select t.tree_id as marker_key, coalesce(p.dbh_cm, t.dbh_cm) as dbh_cm, coalesce(p.height_m, t.height_m) as height_m,
                case when not alive then 'removed' end as status, p.year as prognosis_year
              from trees t left join (select * from p where marker_key % 3 > 0) p on p.marker_key = t.tree_id where coalesce(alive, true)""", "trees")
def _(src):
    p = _projection(src).where("year = 2044 and tree_id % 3 > 0").withColumnRenamed("tree_id", "marker_key")
    markers = src("trees").select(F.col("tree_id").alias("marker_key"), "dbh_cm", "height_m")
    return growth.apply_projection(markers, p, drop_removed=True)


@register("attach_projection", "marker_key:i dbh_cm:4 future_dbh_cm:4 status",
          f"""with {GROW_SQL}, p as (select tree_id as marker_key, dbh_cm, alive from pr where year = 2044)
              select t.tree_id as marker_key, t.dbh_cm, p.dbh_cm as future_dbh_cm, case when alive then 'standing' when not alive then 'removed' end as status
              from trees t left join (select * from p where marker_key % 3 > 0) p on p.marker_key = t.tree_id""", "trees")
def _(src):
    p = _projection(src).where("year = 2044 and tree_id % 3 > 0").withColumnRenamed("tree_id", "marker_key")
    out = growth.apply_projection(src("trees").select(F.col("tree_id").alias("marker_key"), "dbh_cm", "height_m"), p, attach=True)
    return out.select("marker_key", "dbh_cm", F.col("prognosis.dbh_cm").alias("future_dbh_cm"), F.col("prognosis.status").alias("status"))


# ---- scenes ---------------------------------------------------------------------------

LISTING_SQL = """mc as (select scene_id as id, count(*) as n from markers group by 1),
  ls as (select s.id, title, created, concat('/media/', thumb) as thumb_url, concat('/media/', pano) as pano_url, thumb, pano, coalesce(n, 0) as markers, source_type,
    cloud is not null or coalesce(kind = 'tour', false) as has_3d, coalesce(kind, case when video is not null then 'walk' else 'scene' end) as kind
    from scenes s left join mc using (id))"""


def _listing(src):
    counts = src("markers").groupBy(F.col("scene_id").alias("id")).agg(F.count(F.lit(1)).alias("n_markers"))
    return scenes.scene_listing(src("scenes"), counts)


@register("scene_listing", "id title description thumb_url pano_url markers:i source_type has_3d:b kind",
          f"""with {LISTING_SQL} select id, title, '' as description, case when thumb is not null then thumb_url end as thumb_url,
                case when pano is not null then pano_url end as pano_url, markers, source_type, has_3d, kind from ls""", "markers scenes")
def _(src):
    return _listing(src)


@register("scene_order", "id created:t markers:i",
          f"with {LISTING_SQL} select id, created, markers from ls order by created desc nulls last, id", "markers scenes")
def _(src):
    return scenes.scene_order(_listing(src))


@register("dataset_tags", "id tags n_tags:i",
          """with mk as (select scene_id as id, count(*) as n, max(case when height_m > 7 then 1 else 0 end) as qsm, max(case when dx > 80 then 1 else 0 end) as exg,
               max(case when dz > 4.8e0 then 1 else 0 end) as prog from markers group by 1),
             t as (select s.id, [case when pano is not null then 'RGB panorama' end, case when video is not null then 'video walk' end,
               case when splat is not null then 'Gaussian splatting' end, case when cloud is not null then 'LiDAR point cloud' end,
               case when qsm = 1 then 'QSM' end, case when exg = 1 then 'RGB image analysis' end, case when scene_key % 17 = 0 then 'canopy analysis (LAI)' end,
               case when prog = 1 then 'growth projection' end, case when scene_key % 19 = 0 then 'NDVI (CIR)' end,
               case when scene_key % 19 = 0 then 'species suitability' end, case when n > 0 then 'inventory markers' end] as tags
               from scenes s left join mk using (id))
             select id, array_to_string(list_filter(tags, lambda x: x is not null), '|') as tags, len(list_filter(tags, lambda x: x is not null)) as n_tags from t""",
          "markers scenes")
def _(src):
    mk = src("markers").withColumnRenamed("scene_id", "id")
    keys = F.array_compact(F.array(F.max(F.when(F.col("height_m") > 7, "qsm_volume")), F.max(F.when(F.col("dx") > 80, "exg_mean"))))
    facts = mk.groupBy("id").agg(F.count(F.lit(1)).alias("n"), keys.alias("keys"), F.max(F.col("dz") > 4.8).alias("prog"))
    s = src("scenes").join(facts, "id", "left")
    has = {"pano": F.col("pano").isNotNull(), "video": F.col("video").isNotNull(), "splat": F.col("splat").isNotNull(),
           "cloud": F.col("cloud").isNotNull(), "canopy": F.col("scene_key") % 17 == 0, "hedges": F.col("scene_key") % 19 == 0}
    tags = scenes.dataset_tags(has, F.coalesce("keys", F.array().cast("array<string>")), F.coalesce("n", F.lit(0)), F.coalesce("prog", F.lit(False)))
    return s.select("id", tags.alias("t")).select("id", F.array_join("t", "|").alias("tags"), F.size("t").alias("n_tags"))


@register("coordinate_fallback", "id lat:4 lon:4 enrich_lat:4 enrich_lon:4",
          """select id, case when gps_lat is not null then gps_lat else geom_lat end as lat, case when gps_lat is not null then gps_lon else geom_lon end as lon,
               case when geom_lat is not null then geom_lat else gps_lat end as enrich_lat, case when geom_lat is not null then geom_lon else gps_lon end as enrich_lon
             from scenes""", "scenes")
def _(src):
    gps, geom = (F.col("gps_lat"), F.col("gps_lon")), (F.col("geom_lat"), F.col("geom_lon"))
    a, b = scenes.coordinates(gps, geom), scenes.coordinates(gps, geom, False)
    return src("scenes").select("id", a[0].alias("lat"), a[1].alias("lon"), b[0].alias("enrich_lat"), b[1].alias("enrich_lon"))


@register("located_split", "located:i unlocated:i",
          "select count(coalesce(gps_lat, geom_lat)) as located, count(*) - count(coalesce(gps_lat, geom_lat)) as unlocated from scenes", "scenes")
def _(src):
    s = src("scenes").withColumn("lat", F.coalesce("gps_lat", "geom_lat"))
    return scenes.location_split(s)


@register("slug_validation", "name slug_ok:b type_ok:b",
          """select id as name, regexp_matches(case when scene_key % 3 = 0 then upper(id) when scene_key % 5 = 0 then concat('-', id) else id end, '^[a-z0-9][a-z0-9_-]{0,63}$') as slug_ok,
               source_type in ('equirect', 'fisheye', 'e57') as type_ok from scenes""", "scenes")
def _(src):
    name = F.when(F.col("scene_key") % 3 == 0, F.upper("id")).when(F.col("scene_key") % 5 == 0, F.concat(F.lit("-"), "id")).otherwise(F.col("id"))
    return src("scenes").select(F.col("id").alias("name"), scenes.valid_slug(name).alias("slug_ok"), scenes.valid_job_type(F.col("source_type")).alias("type_ok"))


def _publish(src, part):
    s = src("scenes").select("id", F.col("owner_key").alias("publish_key"))
    return scenes.publish_split(s, src("publish_list"), "publish_key")[part]


@register("publish_semi", "id", "select id from scenes where owner_key in (select publish_key from publish_list)", "scenes publish_list")
def _(src):
    return _publish(src, "published")


@register("publish_held", "id", "select id from scenes where owner_key not in (select publish_key from publish_list)", "scenes publish_list")
def _(src):
    return _publish(src, "held")


@register("publish_missing", "publish_key:i", "select publish_key from publish_list except select owner_key from scenes", "scenes publish_list")
def _(src):
    return _publish(src, "missing")


@register("explode_markers", "id pos:i dbh_cm:2 yaw:3",
          "select scene_id as id, row_number() over (partition by scene_id order by pos, marker_key) - 1 as pos, dbh_cm, degrees(atan2(dy, dx)) as yaw from markers", "markers")
def _(src):
    m = src("markers").withColumn("yaw", geometry.yaw_deg(F.col("dx"), F.col("dy"))).withColumnRenamed("scene_id", "id")
    numbered = running_total(m, ["id"], [F.col("pos"), F.col("marker_key")], None, "no")
    rows = numbered.select("id", (F.col("no") - 1).alias("pos"), "dbh_cm", "yaw")
    return scenes.explode_markers(scenes.marker_documents(rows, ["id"]))


@register("scene_manifest", "id part:i n_markers:i title cloud_bin lat:4 sum_dbh:3 height:4 text_height:b variants:i stand:4",
          """with m as (select *, row_number() over (partition by scene_id order by marker_key) - 1 as no from markers),
             d as (select scene_id as id, no // 3 as part, count(*) as n, sum(dbh_cm) as sum_dbh, arg_min(height_m, no) filter (where height_m is not null) as height from m group by 1, 2)
             select id, coalesce(part, 0) as part, coalesce(n, 0) as n_markers, title, cloud as cloud_bin, gps_lat as lat, coalesce(sum_dbh, 0) as sum_dbh, height, false as text_height,
               case when coalesce(part, 0) = 0 and scene_key % 3 = 0 then 2 end as variants, case when coalesce(part, 0) = 0 and scene_key % 5 = 0 then 0.25e0 * (scene_key % 9) end as stand
             from scenes left join d using (id)""", "markers scenes")
def _(src):
    markers = src("markers").select(F.col("scene_id").alias("id"), F.col("marker_key").alias("key"), F.map_from_arrays(
        F.array(F.lit("dbh_cm"), F.lit("height_m")), F.array(F.col("dbh_cm").cast("string"), F.col("height_m").cast("string"))).alias("attributes"))
    numbered = running_total(markers, ["id"], [F.col("key")], None, "pos").withColumn("pos", F.col("pos") - 1).drop("key")
    s = src("scenes")
    name = F.struct(F.lit("summer").alias("name")), F.struct(F.lit("winter").alias("name"))
    blocks = {"variants": s.where("scene_key % 3 = 0").select("id", F.array(*name).alias("value")),
              "stand": s.where("scene_key % 5 = 0").select("id", F.struct((F.col("scene_key") % 9 * 0.25).alias("area_ha")).alias("value"))}
    docs = scenes.scene_manifest(s, numbered, blocks=blocks, part_rows=3)
    body = F.from_json("manifest", "title string, source struct<gps:struct<lat:double>>, pointcloud struct<bin:string>, variants array<struct<name:string>>, "
                                   "stand struct<area_ha:double>, markers array<struct<attributes:variant>>")
    attribute = lambda m, n, t: F.try_variant_get(m["attributes"], f"$.{n}", t)
    known = F.filter(F.transform("d.markers", lambda m: attribute(m, "height_m", "double")), lambda v: v.isNotNull())
    return docs.select("id", "part", body.alias("d")).select(
        "id", "part", F.size("d.markers").alias("n_markers"), "d.title", F.col("d.pointcloud.bin").alias("cloud_bin"), "d.source.gps.lat",
        F.aggregate("d.markers", F.lit(0.0), lambda t, m: t + attribute(m, "dbh_cm", "double")).alias("sum_dbh"),
        F.try_element_at(known, F.lit(1)).alias("height"),
        F.exists("d.markers", lambda m: F.schema_of_variant(m["attributes"]).contains("STRING")).alias("text_height"),
        F.when(F.col("d.variants").isNotNull(), F.size("d.variants")).alias("variants"), F.col("d.stand.area_ha").alias("stand"))


@register("to_markers", "scene_id marker_id label yaw:3 pitch:3 distance_m:2 n_attributes:i rejected:b",
          """select scene_id, concat('t', lpad(cast(pos as varchar), 3, '0')) as marker_id, concat('Object ', cast(pos as varchar)) as label,
               degrees(atan2(dy, dx)) as yaw, degrees(asin(dz/sqrt(dx*dx + dy*dy + dz*dz))) as pitch, sqrt(dx*dx + dy*dy + dz*dz) as distance_m,
               2 + case when height_m is null then 0 else 1 end as n_attributes, sqrt(dx*dx + dy*dy + dz*dz) < 1e-6 as rejected from markers""", "markers")
def _(src):
    rows = src("markers").select("scene_id", F.col("pos").alias("row_no"), (F.col("dx") + 10).alias("x"), (F.col("dy") + 20).alias("y"),
                                 (F.col("dz") + 30).alias("z"), "dbh_cm", "height_m", F.lit("").alias("note"))
    out = scenes.to_markers(rows, (F.lit(10.0), F.lit(20.0), F.lit(30.0)), ["scene_id"])
    return out.withColumn("distance_m", F.col("attributes")["distance_m"].cast("double")).withColumn("n_attributes", F.size("attributes"))


@register("typed_attributes", "scene_id marker_id dbh_cm:3 height_m:4 note grade n_numbers:i",
          """select scene_id, concat('t', lpad(cast(pos as varchar), 3, '0')) as marker_id, dbh_cm, height_m, case when pos % 2 = 0 then 'ok "x"' end as note,
               '1e' as grade, 2 + case when height_m is null then 0 else 1 end as n_numbers from markers""", "markers")
def _(src):
    rows = src("markers").select("scene_id", F.col("pos").alias("row_no"), (F.col("dx") + 10).alias("x"), (F.col("dy") + 20).alias("y"),
                                 (F.col("dz") + 30).alias("z"), "dbh_cm", "height_m", F.when(F.col("pos") % 2 == 0, 'ok "x"').alias("note"), F.lit("1e").alias("grade"))
    typed = scenes.to_markers(rows, (F.lit(10.0), F.lit(20.0), F.lit(30.0)), ["scene_id"]).withColumn("a", scenes.typed_attributes(F.col("attributes")))
    kinds = F.transform(F.map_values(F.col("a").cast("map<string,variant>")), lambda v: F.schema_of_variant(v))
    return typed.select("scene_id", "marker_id", *[F.try_variant_get("a", f"$.{n}", "double").alias(n) for n in ("dbh_cm", "height_m")],
                        *[F.try_variant_get("a", f"$.{n}", "string").alias(n) for n in ("note", "grade")],
                        F.size(F.filter(kinds, lambda k: k != "STRING")).alias("n_numbers"))


@register("check_markers", "scene_id n_valid:i n_rejected:i",
          """select scene_id, count(height_m) as n_valid, count(*) - count(height_m) as n_rejected from markers group by 1""", "markers")
def _(src):
    return scenes.check_markers(_submitted(src), ["scene_id"])[1]


def _submitted(src):
    return src("markers").select("scene_id", "pos", F.lit("").alias("marker_id"), F.lit(None).cast("string").alias("label"),
                                 F.col("dx").cast("string").alias("yaw"), F.coalesce(F.col("height_m").cast("string"), F.lit("n/a")).alias("pitch"),
                                 F.lit("[1]").alias("attributes"), F.lit(None).cast("boolean").alias("demo"))


@register("replace_markers", "scene_id n:i replaced:b",
          """select scene_id, count(*) as n, count(*) = count(height_m) as replaced from markers group by 1""", "markers")
def _(src):
    good, _ = scenes.check_markers(_submitted(src), ["scene_id"])
    old = good.limit(0).unionByName(src("markers").select("scene_id", "pos", F.lit("old").alias("marker_id")), allowMissingColumns=True)
    out = scenes.replace_markers(old, good, ["scene_id"])
    return out.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("marker_id") != "old").alias("replaced"))


@register("upsert_attributes", "marker_key:i dbh_cm:2 leaf:3 n_keys:i",
          """select marker_key, case when marker_key % 2 = 0 then dbh_cm + 1 else dbh_cm end as dbh_cm, case when marker_key % 2 = 0 then dz end as leaf,
               1 + case when marker_key % 2 = 0 then 1 else 0 end as n_keys from markers""", "markers")
def _(src):
    m = src("markers")
    base = m.select("marker_key", F.create_map(F.lit("dbh_cm"), F.col("dbh_cm")).alias("attributes"))
    new = m.where("marker_key % 2 = 0").select("marker_key", F.create_map(F.lit("dbh_cm"), F.col("dbh_cm") + 1, F.lit("leaf"), F.col("dz")).alias("attributes"))
    out = scenes.upsert_attributes(base, new, ["marker_key"])
    return out.select("marker_key", F.col("attributes")["dbh_cm"].alias("dbh_cm"), F.try_element_at("attributes", F.lit("leaf")).alias("leaf"),
                      F.size("attributes").alias("n_keys"))


@register("patch_scenes", "id title", """select id, case when scene_key % 10 = 0 then concat('New ', id) else title end as title from scenes""", "scenes")
def _(src):
    patches = src("scenes").where("scene_key % 10 = 0").select("id", F.concat(F.lit("New "), "id").alias("title"))
    return scenes.patch_scenes(src("scenes"), patches)


@register("delete_scenes", "id", "select id from scenes where scene_key % 6 > 0", "scenes")
def _(src):
    s = src("scenes")
    doomed = s.where("scene_key % 6 = 0").select("id").unionByName(s.where("scene_key % 6 = 1").select(F.lit("").alias("id")))
    return scenes.delete_scenes(s, doomed)[0]


@register("rejected_deletes", "id n:i",
          """select id, count(*) as n from (select case when scene_key % 2 = 0 then '' else concat('gone-', id) end as id from scenes where scene_key % 50 < 2) group by 1""", "scenes")
def _(src):
    s = src("scenes")
    doomed = s.where("scene_key % 50 < 2").select(F.when(F.col("scene_key") % 2 == 0, "").otherwise(F.concat(F.lit("gone-"), "id")).alias("id"))
    return scenes.delete_scenes(s, doomed)[1].groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@register("attribute_keys", "scene_id attribute",
          "select distinct scene_id, unnest(case when height_m is null then ['dbh_cm'] else ['dbh_cm', 'height_m'] end) as attribute from markers", "markers")
def _(src):
    m = src("markers").select("scene_id", F.map_filter(F.create_map(F.lit("dbh_cm"), F.col("dbh_cm"), F.lit("height_m"), F.col("height_m")),
                                                       lambda k, v: v.isNotNull()).alias("attributes"))
    return scenes.attribute_keys(m, ["scene_id"])


@register("storage_footprint", "scene_id bytes:i n_files:i",
          "select concat('u', cast(job_id as varchar)) as scene_id, sum(event_id + 100) as bytes, count(*) as n_files from job_events group by 1", "job_events")
def _(src):
    files = src("job_events").select(F.concat(F.lit("/data/scenes/u"), F.col("job_id").cast("string"), F.lit("/f"), F.col("event_id").cast("string"), F.lit(".bin")).alias("path"),
                                     (F.col("event_id") + 100).alias("length"))
    return scenes.storage_footprint(files)


@register("checksum_check", "name ok:b",
          "select cast(event_id as varchar) as name, event_id % 3 = 1 as ok from job_events", "job_events")
def _(src):
    # every third file carries a wrong sum, every third never landed
    e = src("job_events").select(F.col("event_id").cast("string").alias("name"), "params", "event_id")
    files = e.where("event_id % 3 < 2").select("name", F.encode("params", "utf-8").alias("content"))
    expected = e.select("name", F.upper(F.md5(F.when(F.col("event_id") % 3 == 0, "other").otherwise(F.col("params")))).alias("md5"))
    return scenes.checksum_check(files, expected)


# ---- jobs -------------------------------------------------------------------------------

STATUS_SQL = """js as (select job_id, min(ts) as created, max(ts) as updated, arg_max(status, (ts, event_id)) as status from job_events group by 1)"""


@register("job_status", "job_id:i created:t updated:t status", f"with {STATUS_SQL} select * from js", "job_events")
def _(src):
    return jobs.latest_status(src("job_events"))


@register("job_restart", "job_id:i status", f"with {STATUS_SQL} select job_id, case when status = 'running' then 'queued' else status end as status from js", "job_events")
def _(src):
    return jobs.latest_status(src("job_events")).withColumn("status", jobs.after_restart(F.col("status")))


@register("recent_jobs", "job_id:i created:t status", f"with {STATUS_SQL} select job_id, created, status from js order by created desc, job_id limit 50", "job_events")
def _(src):
    return jobs.recent_jobs(jobs.latest_status(src("job_events")))


@register("open_jobs", "job_id:i created:t", f"with {STATUS_SQL} select job_id, created from js where status = 'queued'", "job_events")
def _(src):
    return jobs.open_jobs(jobs.latest_status(src("job_events")))


@register("job_log", "job_id:i log_tail",
          """select job_id, string_agg(line, chr(10) order by ts, event_id) as log_tail from (select job_id, ts, event_id, concat(status, ' ', params) as line,
               row_number() over (partition by job_id order by ts desc, event_id desc) as rn from job_events) where rn <= 8 group by 1""", "job_events")
def _(src):
    return jobs.job_log(src("job_events"), F.concat_ws(" ", "status", "params"))


# ---- cylinders and splats -------------------------------------------------------------------

CYL_SQL = "g as (select *, pi()*radius*radius*(end_z - start_z) as vol, 2*pi()*radius*(end_z - start_z) as surf from cylinders)"
QSM_SQL = CYL_SQL + """, q as (select tree_id, sum(vol)*1000 as volume_l, sum(surf) as surface_m2, max(end_z) - min(start_z) as height_m, max(branch_order) as max_order,
    count(*) as n_cylinders, 200*median(radius) filter (where start_z <= 1.4e0 and end_z >= 1.2e0 and branch_order <= 1) as dbh_cm from g group by 1)"""


@register("cylinder_geometry", "cyl_idx:i length_m:6 volume_m3:8 surface_m2:8",
          f"with {CYL_SQL} select cyl_idx, end_z - start_z as length_m, vol as volume_m3, surf as surface_m2 from g", "cylinders")
def _(src):
    return cyl.cylinder_geometry(src("cylinders"))


@register("qsm_summary", "tree_id:i volume_l:5 surface_m2:5 height_m:5 max_order:i n_cylinders:i dbh_cm:4", f"with {QSM_SQL} select * from q", "cylinders")
def _(src):
    return cyl.qsm_summary(src("cylinders"))


@register("qsm_by_order", "tree_id:i branch_order:i volume_l:5 n_cylinders:i",
          f"with {CYL_SQL} select tree_id, branch_order, sum(vol)*1000 as volume_l, count(*) as n_cylinders from g group by grouping sets ((tree_id, branch_order), (tree_id))", "cylinders")
def _(src):
    return cyl.qsm_by_order(src("cylinders"))


@register("attach_qsm", "tree_id:i dbh_cm:3 qsm_volume_l:5 qsm_dbh_cm:4",
          f"""with {QSM_SQL} select t.tree_id, t.dbh_cm, nullif(q.volume_l, 0) as qsm_volume_l,
                case when abs(q.dbh_cm - t.dbh_cm)/t.dbh_cm <= 0.25e0 then nullif(q.dbh_cm, 0) end as qsm_dbh_cm from trees t left join q using (tree_id)""", "cylinders trees")
def _(src):
    return cyl.attach_qsm(src("trees"), cyl.qsm_summary(src("cylinders")))


@register("splat_decode", "splat_id:i alpha:6 radius_0:6 r:i g:i b:i",
          """select splat_id, 1/(1 + exp(-opacity)) as alpha, exp(scale_0) as radius_0,
               floor(least(greatest(0.5e0 + 0.28209479177387814e0*f_dc_0, 0), 1)*255) as r, floor(least(greatest(0.5e0 + 0.28209479177387814e0*f_dc_1, 0), 1)*255) as g,
               floor(least(greatest(0.5e0 + 0.28209479177387814e0*f_dc_2, 0), 1)*255) as b from splats""", "splats")
def _(src):
    return cyl.splat_decode(src("splats"))


CLEAN_SQL = """m as (select median(x) as mx, median(y) as my, median(z) as mz from splats),
  d as (select s.*, sqrt((x-mx)*(x-mx) + (y-my)*(y-my) + (z-mz)*(z-mz)) as d from splats s, m),
  e as (select quantile_cont(d, 0.96e0) as edge from d),
  cl as (select d.* from d, e where d <= edge and greatest(exp(scale_0), exp(scale_1), exp(scale_2)) <= 0.6e0 and 1/(1 + exp(-opacity)) >= 0.12e0)"""


@register("splat_clean", "splat_id:i x:4", f"with {CLEAN_SQL} select splat_id, x from cl", "splats")
def _(src):
    return cyl.splat_clean(src("splats"))


@register("topn_opacity", "splat_id:i opacity:6", f"with {CLEAN_SQL} select splat_id, opacity from cl order by opacity desc, splat_id limit 500", "splats")
def _(src):
    from canopyframe.operators.sampling import top_n
    return top_n(cyl.splat_clean(src("splats")), "opacity", 500, "splat_id")


_ENCODED = ("x", "y", "z", "nx", "ny", "nz", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3")


@register("splat_encode", "splat_id:i " + " ".join(f"{c}:8" for c in _ENCODED),
          """select point_idx as splat_id, x, y, z, 0e0 as nx, 0e0 as ny, 0e0 as nz, (r/255e0 - 0.5e0)/0.28209479177387814e0 as f_dc_0,
               (g/255e0 - 0.5e0)/0.28209479177387814e0 as f_dc_1, (b/255e0 - 0.5e0)/0.28209479177387814e0 as f_dc_2, 8e0 as opacity,
               ln(0.03e0) as scale_0, ln(0.03e0) as scale_1, ln(0.03e0) as scale_2, 1e0 as rot_0, 0e0 as rot_1, 0e0 as rot_2, 0e0 as rot_3 from points""", "points")
def _(src):
    return cyl.points_to_splats(src("points"), keep=("point_idx",)).withColumnRenamed("point_idx", "splat_id")


@register("splat_frame", "lo_x:5 hi_x:5 focus_x:5 lo_y:5 hi_y:5 focus_y:5 lo_z:5 hi_z:5 focus_z:5",
          "select " + ", ".join(f"quantile_cont({a}, 0.02e0) as lo_{a}, quantile_cont({a}, 0.98e0) as hi_{a}, median({a}) as focus_{a}" for a in "xyz") + " from splats", "splats")
def _(src):
    return cyl.splat_frame(src("splats"))


_AXIS_SQL = """cv as (select {keys} avg(x) as mx, avg(y) as my, avg(z) as mz, covar_samp(x, x) as xx, covar_samp(x, y) as xy, covar_samp(x, z) as xz,
    covar_samp(y, y) as yy, covar_samp(y, z) as yz, covar_samp(z, z) as zz from splats {by}),
  sh as (select *, (xx + yy + zz)/3 as q, sqrt(((xx - (xx+yy+zz)/3)**2 + (yy - (xx+yy+zz)/3)**2 + (zz - (xx+yy+zz)/3)**2 + 2*(xy*xy + xz*xz + yz*yz))/6) as p from cv),
  ev as (select *, q + 2*p*cos(acos(least(greatest(((xx-q)*((yy-q)*(zz-q) - yz*yz) - xy*(xy*(zz-q) - yz*xz) + xz*(xy*yz - (yy-q)*xz))/(p*p*p)/2, -1), 1))/3 + 2*pi()/3) as e from sh),
  cr as (select *, unnest([[xy*yz - xz*(yy-e), xz*xy - (xx-e)*yz, (xx-e)*(yy-e) - xy*xy], [xy*(zz-e) - xz*yz, xz*xz - (xx-e)*(zz-e), (xx-e)*yz - xy*xz],
    [(yy-e)*(zz-e) - yz*yz, yz*xz - xy*(zz-e), xy*yz - (yy-e)*xz]]) as v from ev),
  ax as (select * from (select *, sqrt(v[1]*v[1] + v[2]*v[2] + v[3]*v[3]) as len, row_number() over ({part} order by v[1]*v[1] + v[2]*v[2] + v[3]*v[3] desc) as rn from cr) where rn = 1),
  pr as (select {skeys} ((x-mx)*v[1] + (y-my)*v[2] + (z-mz)*v[3])/len as t from splats s join ax on {on}),
  sg as (select {keys} case when avg(t) < median(t) then -1e0 else 1e0 end as s from pr {by})
  select {okeys} s*v[1]/len as up_x, s*v[2]/len as up_y, s*v[3]/len as up_z from ax join sg on {son}"""


@register("up_axis", "up_x:6 up_y:6 up_z:6", "with " + _AXIS_SQL.format(keys="", by="", part="", skeys="", on="true", okeys="", son="true"), "splats")
def _(src):
    return cyl.up_axis(src("splats"))


@register("up_axis_by_group", "block:i up_x:6 up_y:6 up_z:6",
          "with " + _AXIS_SQL.replace("from splats", "from (select *, splat_id % 7 as block from splats)").format(
              keys="block, ", by="group by block", part="partition by block", skeys="s.block, ", on="ax.block = s.block", okeys="ax.block, ", son="sg.block = ax.block"),
          "splats")
def _(src):
    return cyl.up_axis(src("splats").withColumn("block", F.col("splat_id") % 7), ["block"])


# ---- learning -----------------------------------------------------------------------------------


@register("group_split", "image_id:i fold:i",
          "select distinct image_id, cast(concat('0x', substr(md5(cast(image_id as varchar)), 1, 8)) as bigint) % 4 as fold from pixels", "pixels")
def _(src):
    return learning.group_split(src("pixels").select("image_id").distinct(), "image_id")


@register("class_weights", "species_name weight:6",
          "select species_name, sum(count(*)) over ()/(count(*) over ()*count(*)) as weight from trees group by 1", "trees")
def _(src):
    return learning.class_weights(src("trees"), "species_name").select("species_name", "weight").distinct()


@register("confusion_matrix", "actual predicted n:i",
          "select o_orderstatus as actual, case when o_totalprice > 250000 then 'F' else 'O' end as predicted, count(*) as n from orders group by 1, 2", "views")
def _(src):
    return learning.confusion_matrix(_predictions(src), "actual", "predicted")


def _predictions(src):
    return src("views").select(F.col("verdict").alias("actual"), F.when(F.col("green_share") * 500000 > 250000, "F").otherwise("O").alias("predicted"))


@register("class_report", "class support:i precision:6 recall:6 f1:6 accuracy:6",
          """with p as (select o_orderstatus as a, case when o_totalprice > 250000 then 'F' else 'O' end as p from orders),
             c as (select a as class, count(*) as support, count(*) filter (where a = p) as tp from p group by 1), q as (select p as class, count(*) as np from p group by 1)
             select class, support, coalesce(tp/np, 0) as precision, tp/support as recall, coalesce(2*(tp/np)*(tp/support)/nullif(tp/np + tp/support, 0), 0) as f1,
               (select count(*) filter (where a = p)/count(*) from p) as accuracy from c left join q using (class)""", "views")
def _(src):
    return learning.class_report(_predictions(src), "actual", "predicted")


@register("species_forest", "image_id:i species species_conf:6")
def _(src):
    return learning.cross_species(_labelled_images(src), px.FEATURE_NAMES, "label", "image_id")


def _labelled_images(src):
    """Figures of each image with a label that comes from another column than the pixels, and its fold."""
    from canopyframe.runtime import cut_lineage
    feats = px.segment_features(src("pixels"), ["image_id"])
    names = F.array(F.lit("spruce"), F.lit("pine"), F.lit("birch"))
    labels = src("image_labels").select("image_id", F.element_at(names, F.col("class_no") + 1).alias("label"))
    return cut_lineage(learning.group_split(feats.join(labels, "image_id"), "image_id"))


@register("habitat_types", "seg_id:i habitat_type:i")
def _(src):
    from canopyframe.plans.queries.landscape import _metrics
    return learning.habitat_types(_metrics(src), ["fhd", "vci", "h_p95", "canopy_sd"])
