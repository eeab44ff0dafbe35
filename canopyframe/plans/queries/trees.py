"""Queries on single trees, stands, samples and coordinate frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyframe.functions import crs, geometry
from canopyframe.operators import inventory, sampling, singletree
from canopyframe.plans.catalog import register

SLICE_SQL = """base as (select label, quantile_cont(z, 0.01e0) as base_z from points group by 1),
  rel as (select p.*, b.base_z, p.z - b.base_z as rel_z from points p join base b using (label))"""


def fit_sql(source: str, key: str, out: str) -> str:
    """Oracle for the circle fit of ``source`` rows (x, y) grouped by ``key``."""
    return f"""{out}_m as (select *, avg(x) over w as rx, avg(y) over w as ry from {source} window w as (partition by {key})),
  {out}_l as (select *, x-rx as u, y-ry as v, (x-rx)*(x-rx) + (y-ry)*(y-ry) as w from {out}_m),
  {out}_s as (select {key}, rx, ry, count(*) as n_fit, avg(u*u) as suu, avg(v*v) as svv, avg(u*v) as suv, avg(u*w) as suw,
    avg(v*w) as svw, avg(w) as mw from {out}_l group by {key}, rx, ry),
  {out}_f as (select *, (suw*svv - svw*suv)/(suu*svv - suv*suv)/2 as a, (svw*suu - suw*suv)/(suu*svv - suv*suv)/2 as c from {out}_s),
  {out} as (select {key}, n_fit, rx + a as fit_x, ry + c as fit_y, sqrt(mw + a*a + c*c) as radius_m from {out}_f)"""


@register("single_tree_metrics", "label:i x:6 y:6 base_z:5 height_m:5 dbh_cm:3 leaf_share_pct:8 n_points:i",
          f"""with {SLICE_SQL}, sl as (select * from rel where rel_z between 1.0e0 and 1.6e0), {fit_sql('sl', 'label', 'fit')},
              res as (select s.label, sqrt(avg(pow(sqrt((x-fit_x)*(x-fit_x) + (y-fit_y)*(y-fit_y)) - radius_m, 2))) as rms
                from sl s join fit f on f.label = s.label group by 1),
              tot as (select label, max(base_z) as base_z, max(rel_z) as height_m, count(*) as n_points,
                100*avg(case when class = 1 then 1e0 else 0e0 end) as leaf_share_pct,
                coalesce(avg(x) filter (where rel_z between 1.0e0 and 1.6e0), avg(x)) as x,
                coalesce(avg(y) filter (where rel_z between 1.0e0 and 1.6e0), avg(y)) as y from rel group by 1)
              select t.*, case when n_fit >= 30 and radius_m between 0.02e0 and 0.8e0 and rms <= 0.05e0 then radius_m*200 end as dbh_cm
              from tot t left join fit f on f.label = t.label left join res r on r.label = t.label""", "points")
def _(src):
    return singletree.single_tree_metrics(src("points"))


@register("trunk_center", "label:i x:6 y:6 n_cell:i",
          """with c as (select label, floor(x/0.25e0) as kx, floor(y/0.25e0) as ky, count(*) as n, avg(x) as x, avg(y) as y
               from points where class = 0 group by 1, 2, 3)
             select label, x, y, n as n_cell from (select *, row_number() over (partition by label order by n desc, kx, ky) as rn from c)
             where rn = 1""", "points")
def _(src):
    return singletree.trunk_center(src("points").where("class = 0"))


def _gated_oracle() -> str:
    parts = ["""cellc as (select label, floor(x/0.25e0) as kx, floor(y/0.25e0) as ky, count(*) as n, avg(x) as x, avg(y) as y
               from sl group by 1, 2, 3),
             sizes as (select label from sl group by 1 having count(*) >= 40),
             s0 as (select label, x as cx, y as cy, 0.9e0 as gate, cast(null as double) as px, cast(null as double) as py,
               cast(null as double) as pgate, cast(null as double) as radius_m, 0 as rounds_done, true as active
               from (select *, row_number() over (partition by label order by n desc, kx, ky) as rn from cellc) c
               where rn = 1 and label in (select label from sizes))"""]
    for k in range(1, 7):
        p = f"s{k-1}"
        parts.append(f"""near{k} as materialized (select sl.label, sl.x, sl.y from sl join {p} s on s.label = sl.label
               where s.active and sqrt((sl.x-s.cx)*(sl.x-s.cx) + (sl.y-s.cy)*(sl.y-s.cy)) <= s.gate),
             {fit_sql(f'near{k}', 'label', f'f{k}')},
             s{k} as materialized (select s.label, case when ok then fit_x else cx end as cx, case when ok then fit_y else cy end as cy,
               case when ok then greatest(r*1.35e0, 0.12e0) else gate end as gate, case when ok then cx else px end as px,
               case when ok then cy else py end as py, case when ok then gate else pgate end as pgate,
               case when ok then r else radius_m end as radius_m, rounds_done + case when ok then 1 else 0 end as rounds_done, ok as active
               from (select s.*, f.fit_x, f.fit_y, f.radius_m as r,
                 s.active and coalesce(f.n_fit, 0) >= 40 and f.radius_m is not null as ok
                 from {p} s left join f{k} f on f.label = s.label) s)""")
    return ", ".join(parts)


@register("gated_fit", "label:i x:5 y:5 radius_m:5 fit_rms_m:5 arc_deg:i rounds_done:i",
          f"""with sl as (select * from points where class <= 1 and z between 1.0e0 and 1.6e0), {_gated_oracle()}
              select s.label, s.cx as x, s.cy as y, s.radius_m, s.rounds_done, q.fit_rms_m, q.arc_deg from s6 s left join (
                select s.label, sqrt(avg(pow(sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy)) - radius_m, 2))) as fit_rms_m,
                  count(distinct least(floor((degrees(atan2(y-cy, x-cx)) + 180)/10), 35))*10 as arc_deg
                from sl join s6 s on s.label = sl.label
                where sqrt((x-px)*(x-px) + (y-py)*(y-py)) <= pgate group by 1) q on q.label = s.label""", "points")
def _(src):
    return singletree.gated_fit(src("points").where("class <= 1 and z between 1.0 and 1.6"))


@register("classified_tree_metrics", "label:i x:5 y:5 base_z:5 height_m:5 dbh_cm:3 leaf_share_pct:7 n_points:i",
          f"""with {SLICE_SQL}, sl as (select * from rel where rel_z between 1.2e0 and 1.4e0 and class = 0), {_gated_oracle()},
              q as (select s.label, sqrt(avg(pow(sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy)) - radius_m, 2))) as rms,
                  count(distinct least(floor((degrees(atan2(y-cy, x-cx)) + 180)/10), 35))*10 as arc
                from sl join s6 s on s.label = sl.label where sqrt((x-px)*(x-px) + (y-py)*(y-py)) <= pgate group by 1),
              tot as (select label, max(base_z) as base_z, max(rel_z) as height_m, avg(x) as mx, avg(y) as my, count(*) as n_points,
                100*avg(case when class = 1 then 1e0 else 0e0 end) as leaf_share_pct from rel group by 1)
              select t.label, base_z, height_m, n_points, leaf_share_pct, case when radius_m is not null then cx else mx end as x,
                case when radius_m is not null then cy else my end as y,
                case when radius_m between 0.02e0 and 1.2e0 and rms <= 0.03e0 and arc >= 180 then radius_m*200 end as dbh_cm
              from tot t left join s6 s on s.label = t.label left join q on q.label = t.label""", "points")
def _(src):
    return singletree.classified_tree_metrics(src("points"))


@register("gt_positions", "label:i x:6 y:6 n_points:i",
          """with base as (select label, quantile_cont(z, 0.02e0) as base_z, count(*) as n_points from points
               where label not in (-100, 0) group by 1 having count(*) >= 40),
             rel as (select p.*, b.n_points, p.z - b.base_z between 0.3e0 and 1.8e0 as in_band from points p join base b using (label)),
             agg as (select label, any_value(n_points) as n_points, count(*) filter (where in_band) as nb,
               median(x) filter (where in_band) as bx, median(y) filter (where in_band) as by_, median(x) as ax, median(y) as ay
               from rel group by 1)
             select label, case when nb >= 3 then bx else ax end as x, case when nb >= 3 then by_ else ay end as y, n_points from agg""",
          "points")
def _(src):
    return singletree.reference_positions(src("points"))


@register("tree_attributes", "tree_id:i dbh_cm:4 basal_area_m2:8 height_m:4 observed_height_m:4 volume_m3:6 slenderness:5",
          """with t as (select tree_id, dbh_cm/200 as radius_m, height_m as observed from trees)
             select tree_id, radius_m*200 as dbh_cm, pi()*radius_m*radius_m as basal_area_m2,
               case when observed >= 5 then observed end as height_m, case when observed < 5 then observed end as observed_height_m,
               case when observed >= 5 then pi()*radius_m*radius_m*observed*0.5e0 end as volume_m3,
               case when observed >= 5 then observed*100/(radius_m*200) end as slenderness from t""", "trees")
def _(src):
    t = src("trees").select("tree_id", (F.col("dbh_cm") / 200).alias("radius_m"), F.col("height_m").alias("top_z"),
                            F.lit(0.0).alias("ground"))
    return inventory.tree_attributes(t)


@register("crown_radius", "tree_id:i crown_radius_m:6",
          """select tree_id, least(greatest(0.6e0 + 0.06e0*coalesce(nullif(case when tree_id % 9 = 0 then 0e0
               when tree_id % 10 = 0 then null else dbh_cm end, 0), 20), 1.5e0), 4.0e0) as crown_radius_m from trees""", "trees")
def _(src):
    dbh = F.when(F.col("tree_id") % 9 == 0, F.lit(0.0)).when(F.col("tree_id") % 10 == 0, None).otherwise(F.col("dbh_cm"))
    return src("trees").select("tree_id", inventory.crown_radius(dbh).alias("crown_radius_m"))


STAND_SQL = """t as (select *, pi()*dbh_cm*dbh_cm/40000 as basal_area_m2,
      case when height_m > 3 then pi()*dbh_cm*dbh_cm/40000*height_m*0.5e0 end as volume_m3,
      case when height_m > 3 then height_m*100/dbh_cm end as slenderness from trees)"""


def _stand_trees(src):
    area = F.lit(3.141592653589793) * F.col("dbh_cm") * F.col("dbh_cm") / 40000
    return src("trees").withColumn("basal_area_m2", area).withColumn(
        "volume_m3", F.when(F.col("height_m") > 3, area * F.col("height_m") * 0.5)).withColumn(
        "slenderness", F.when(F.col("height_m") > 3, F.col("height_m") * 100 / F.col("dbh_cm")))


@register("stand_summary", "stand_id:i n_stems:i stems_per_ha:4 basal_area_m2:6 basal_area_m2_ha:4 dbh_mean_cm:5 dg_cm:5 "
          "dbh_min_cm:3 dbh_max_cm:3 height_mean_m:5 stock_m3:5 stock_m3_ha:4 slenderness_mean:4 dbh_sd_cm:5 n_heights:i sdi:3 structure",
          f"""with {STAND_SQL}, a as (select stand_id, count(*) as n_stems, sum(basal_area_m2) as basal_area_m2, avg(dbh_cm) as dbh_mean_cm,
                sqrt(avg(dbh_cm*dbh_cm)) as dg_cm, min(dbh_cm) as dbh_min_cm, max(dbh_cm) as dbh_max_cm, avg(height_m) as height_mean_m,
                sum(volume_m3) as stock_m3, avg(slenderness) as slenderness_mean, stddev_pop(dbh_cm) as dbh_sd_cm,
                count(height_m) as n_heights from t group by 1)
              select *, n_stems/0.25e0 as stems_per_ha, basal_area_m2/0.25e0 as basal_area_m2_ha, stock_m3/0.25e0 as stock_m3_ha,
                n_stems/0.25e0*pow(dg_cm/25, 1.605e0) as sdi,
                case when dbh_sd_cm < 10 then 'single-layered' else 'multi-layered' end as structure from a""", "trees")
def _(src):
    return inventory.stand_summary(_stand_trees(src), 0.25, ["stand_id"])


@register("dbh_histogram", "stand_id:i lower_cm:i upper_cm:i n_stems:i",
          """with mx as (select stand_id, max(dbh_cm) as m from trees group by 1),
             bins as (select stand_id, m, unnest(range(0, cast(greatest(ceil(m/10), 1) as bigint))) as b from mx)
             select b.stand_id, b.b*10 as lower_cm, b.b*10 + 10 as upper_cm, count(t.dbh_cm) as n_stems
             from bins b left join trees t on t.stand_id = b.stand_id and
               least(floor(t.dbh_cm/10), greatest(ceil(b.m/10), 1) - 1) = b.b group by 1, 2, 3""", "trees")
def _(src):
    return inventory.dbh_histogram(src("trees"), ["stand_id"])


@register("top_height", "stand_id:i top_height_m:6 n_used:i",
          """select stand_id, avg(height_m) as top_height_m, count(*) as n_used from (
               select *, row_number() over (partition by stand_id order by height_m desc) as rn from trees where height_m is not null)
             where rn <= 25 group by 1""", "trees")
def _(src):
    return inventory.top_height(src("trees"), 0.25, ["stand_id"])


@register("label_trees", "tree_id:i label",
          """select tree_id, 't' || lpad(cast(row_number() over (partition by stand_id order by dbh_cm desc, tree_id) as varchar), 3, '0') as label
             from trees""", "trees")
def _(src):
    return inventory.label_trees(src("trees"), ["stand_id"], [F.col("dbh_cm").desc(), F.col("tree_id")], "t", 3)


@register("local_frame", "point_idx:i lx:5 ly:5 lz:5",
          """with f as (select label, avg(x) as fx, avg(y) as fy, quantile_cont(z, 0.01e0) as fz from points group by 1)
             select point_idx, x - fx as lx, y - fy as ly, z - fz as lz from points join f using (label)""", "points")
def _(src):
    return inventory.local_frame(src("points"), ["label"])


@register("scene_origin", "origin_x:5 origin_y:5 origin_z:5",
          """with f as (select label, avg(x) as fx, avg(y) as fy, min(z) as fz from points group by 1)
             select avg(fx) as origin_x, avg(fy) as origin_y, min(fz) as origin_z from f""", "points")
def _(src):
    framed = inventory.local_frame(src("points"), ["label"], None)
    feet = framed.groupBy("label").agg(F.first("foot_x").alias("foot_x"), F.first("foot_y").alias("foot_y"),
                                       F.first("foot_z").alias("foot_z"))
    return inventory.scene_origin(feet, [])


@register("leaf_share", "label:i leaf_share_pct:6 wood_share_pct:6",
          """select label, 100*avg(case when class = 1 then 1e0 else 0e0 end) as leaf_share_pct,
               100*avg(case when class = 0 then 1e0 else 0e0 end) as wood_share_pct from points group by 1""", "points")
def _(src):
    return src("points").groupBy("label").agg((F.avg((F.col("class") == 1).cast("double")) * 100).alias("leaf_share_pct"),
                                              (F.avg((F.col("class") == 0).cast("double")) * 100).alias("wood_share_pct"))


@register("class_filter", "class:i n_points:i mean_hag:5",
          "select class, count(*) as n_points, avg(hag) as mean_hag from als where class not in (6, 9, 26) and hag >= -0.5e0 and hag < 40 group by 1",
          "als")
def _(src):
    from canopyframe.operators.structure import drop_infrastructure
    return drop_infrastructure(src("als")).groupBy("class").agg(F.count(F.lit(1)).alias("n_points"), F.avg("hag").alias("mean_hag"))


# ---- sampling ---------------------------------------------------------------

@register("voxel_thin", "point_idx:i x:4 y:4 z:4",
          """select point_idx, x, y, z from (select *, row_number() over (partition by tile_id, floor(x/0.1e0), floor(y/0.1e0), floor(z/0.1e0)
               order by point_idx) as rn from points) where rn = 1""", "points")
def _(src):
    return sampling.voxel_thin(src("points"), 0.1)


@register("sample_cap", "point_idx:i x:4 y:4 z:4",
          "select point_idx, x, y, z from points order by md5(concat('7:', tile_id, ':', cast(point_idx as varchar))), point_idx limit 2500",
          "points")
def _(src):
    return sampling.sample_cap(src("points"), 2500, ["tile_id", "point_idx"], seed=7)


@register("sample_cap_per_tree", "label:i point_idx:i",
          """select label, point_idx from (select *, row_number() over (partition by label
               order by md5(concat('0:', cast(point_idx as varchar)))) as rn from points) where rn <= 40""", "points")
def _(src):
    return sampling.sample_cap(src("points"), 40, ["point_idx"], ["label"])


@register("stratified_cap", "point_idx:i class:i",
          """with k as (select *, md5(concat('0:', cast(point_idx as varchar))) as h, class = 1 as f from points),
             r as (select *, row_number() over (partition by f order by h) as rn, sum(case when f then 1 else 0 end) over () as nf from k)
             select point_idx, class from r where (f and rn <= 3500) or (not f and rn <= 5000 - least(nf, 3500))""", "points")
def _(src):
    return sampling.stratified_cap(src("points"), F.col("class") == 1, 5000, ["point_idx"])


@register("stride_sample", "point_idx:i x:4", "select point_idx, x from points where point_idx % 25 = 0", "points")
def _(src):
    return sampling.stride_sample(src("points"), 25)


@register("lod_levels", "level n_points:i min_x:4 max_x:4",
          """with a as (select *, row_number() over (partition by floor(x/0.1e0), floor(y/0.1e0), floor(z/0.1e0) order by point_idx) as rn from points),
             b as (select *, row_number() over (partition by floor(x/0.04e0), floor(y/0.04e0), floor(z/0.04e0) order by point_idx) as rn from points),
             la as (select *, row_number() over (order by md5(concat('0:', tile_id, ':', cast(point_idx as varchar)))) as k from a where rn = 1),
             lb as (select *, row_number() over (order by md5(concat('0:', tile_id, ':', cast(point_idx as varchar)))) as k from b where rn = 1)
             select 'lite' as level, count(*) as n_points, min(x) as min_x, max(x) as max_x from la where k <= 1600
             union all select 'full', count(*), min(x), max(x) from lb where k <= 7000""", "points")
def _(src):
    levels = sampling.lod_levels(src("points"), {"lite": (0.10, 1600), "full": (0.04, 7000)})
    return levels.groupBy("level").agg(F.count(F.lit(1)).alias("n_points"), F.min("x").alias("min_x"), F.max("x").alias("max_x"))


@register("bbox_stats", "label:i n_points:i min_x:4 max_x:4 mean_x:6 min_y:4 max_y:4 mean_y:6 min_z:4 max_z:4 mean_z:6",
          """select label, count(*) as n_points, min(x) as min_x, max(x) as max_x, avg(x) as mean_x, min(y) as min_y, max(y) as max_y,
               avg(y) as mean_y, min(z) as min_z, max(z) as max_z, avg(z) as mean_z from points group by 1""", "points")
def _(src):
    return sampling.bounding_boxes(src("points"), ["label"])


@register("grid_layout", "tree_id:i off_x:1 off_y:1",
          """with n as (select tree_id, row_number() over (order by tree_id) - 1 as i, cast(ceil(sqrt(count(*) over ())) as bigint) as cols from trees)
             select tree_id, (i % cols)*16e0 as off_x, floor(i/cols)*16e0 as off_y from n""", "trees")
def _(src):
    return sampling.grid_layout(src("trees"), [F.col("tree_id")])


# ---- frames and coordinates ---------------------------------------------------

@register("marker_angles", "marker_key:i yaw:3 pitch:3 distance_m:2",
          """select marker_key, degrees(atan2(dy, dx)) as yaw, degrees(asin(dz/sqrt(dx*dx + dy*dy + dz*dz))) as pitch,
               sqrt(dx*dx + dy*dy + dz*dz) as distance_m from markers where sqrt(dx*dx + dy*dy + dz*dz) >= 1e-6""", "markers")
def _(src):
    d = [F.col(c) for c in ("dx", "dy", "dz")]
    return src("markers").where(geometry.distance3(*d) >= 1e-6).select(
        "marker_key", geometry.yaw_deg(d[0], d[1]).alias("yaw"), geometry.pitch_deg(*d).alias("pitch"),
        geometry.distance3(*d).alias("distance_m"))


@register("frame_transform", "point_idx:i sx:4 sy:4 sz:4",
          "select point_idx, x - 12.5e0 as sx, z - 1.25e0 as sy, -(y - 3.5e0) as sz from points", "points")
def _(src):
    xyz = geometry.y_up(*[F.col(c) for c in "xyz"], F.lit(12.5), F.lit(3.5), F.lit(1.25))
    return src("points").select("point_idx", *[c.alias(n) for c, n in zip(xyz, ("sx", "sy", "sz"))])


@register("view_directions", "marker_key:i ux:6 uy:6 uz:6",
          """select marker_key, cos(radians(dy*10))*cos(radians(dx)) as ux, cos(radians(dy*10))*sin(radians(dx)) as uy,
               sin(radians(dy*10)) as uz from markers""", "markers")
def _(src):
    u = geometry.direction(F.col("dx"), F.col("dy") * 10)
    return src("markers").select("marker_key", *[c.alias(n) for c, n in zip(u, ("ux", "uy", "uz"))])


@register("rd_to_wgs84", "point_idx:i lat:6 lon:6",
          """with t as (select point_idx, (x*700 - 5000)*1e-5 as dx, (y*9000 - 40000)*1e-5 as dy from points)
             select point_idx,
               52.15517440e0 + (3235.65389e0*dy - 32.58297e0*dx*dx - 0.24750e0*dy*dy - 0.84978e0*dx*dx*dy - 0.06550e0*dy*dy*dy
                 - 0.01709e0*dx*dx*dy*dy - 0.00738e0*dx + 0.00530e0*dx*dx*dx*dx - 0.00039e0*dx*dx*dy*dy*dy + 0.00033e0*dx*dx*dx*dx*dy
                 - 0.00012e0*dx*dy)/3600 as lat,
               5.38720621e0 + (5260.52916e0*dx + 105.94684e0*dx*dy + 2.45656e0*dx*dy*dy - 0.81885e0*dx*dx*dx + 0.05594e0*dx*dy*dy*dy
                 - 0.05607e0*dx*dx*dx*dy + 0.01199e0*dy + 0.00256e0*dx*dx*dx*dy*dy + 0.00128e0*dx*dy*dy*dy*dy + 0.00022e0*dy*dy
                 - 0.00022e0*dx*dx*dy + 0.00026e0*dx*dx*dx*dx*dx)/3600 as lon from t""", "points")
def _(src):
    lat, lon = crs.rd_to_wgs84(F.col("x") * 700 + 150000, F.col("y") * 9000 + 423000)
    return src("points").select("point_idx", lat.alias("lat"), lon.alias("lon"))


@register("utm_to_wgs84", "point_idx:i lat:6 lon:6",
          """with c as (select 6378137e0 as a, 0.9996e0 as k0, (1/298.257223563e0)*(2 - 1/298.257223563e0) as e2,
               (1/298.257223563e0)/(2 - 1/298.257223563e0) as n),
             t as (select point_idx, x*900 + 400000 as e, y*5000 + 5400000 as nn, c.*, e2/(1-e2) as ep2 from points, c),
             m as (select *, nn/(k0*a*(1 - e2/4 - 3*e2*e2/64 - 5*e2*e2*e2/256)) as mu from t),
             p as (select *, mu + (3*n/2 - 27*n*n*n/32)*sin(2*mu) + (21*n*n/16 - 55*n*n*n*n/32)*sin(4*mu) + (151*n*n*n/96)*sin(6*mu) as p from m),
             q as (select *, ep2*cos(p)*cos(p) as c1, tan(p)*tan(p) as t1, a*(1-e2)/pow(1 - e2*sin(p)*sin(p), 1.5e0) as r1,
               a/sqrt(1 - e2*sin(p)*sin(p)) as n1 from p),
             d as (select *, (e - 500000)/(n1*k0) as d from q)
             select point_idx,
               degrees(p - (n1*tan(p)/r1)*(d*d/2 - (5 + 3*t1 + 10*c1 - 4*c1*c1 - 9*ep2)*pow(d, 4)/24
                 + (61 + 90*t1 + 298*c1 + 45*t1*t1 - 252*ep2 - 3*c1*c1)*pow(d, 6)/720)) as lat,
               degrees((d - (1 + 2*t1 + c1)*pow(d, 3)/6 + (5 - 2*c1 + 28*t1 - 3*c1*c1 + 8*ep2 + 24*t1*t1)*pow(d, 5)/120)/cos(p)) + 9 as lon from d""",
          "points")
def _(src):
    lat, lon = crs.utm_to_wgs84(F.col("x") * 900 + 400000, F.col("y") * 5000 + 5400000)
    return src("points").select("point_idx", lat.alias("lat"), lon.alias("lon"))


@register("metres_to_degrees", "id dlat:9 dlon:9",
          "select id, 30e0/111320e0 as dlat, 30e0/(111320e0*greatest(cos(radians(gps_lat)), 1e-6)) as dlon from scenes where gps_lat is not null",
          "scenes")
def _(src):
    dlat, dlon = geometry.metres_to_degrees(F.lit(30.0), F.col("gps_lat"))
    return src("scenes").where("gps_lat is not null").select("id", dlat.alias("dlat"), dlon.alias("dlon"))


@register("minmax_rescale", "point_idx:i intensity:i",
          """select point_idx, floor((z - lo)/(case when hi > lo then hi - lo else 1 end)*65535) as intensity
             from points, (select min(z) as lo, max(z) as hi from points)""", "points")
def _(src):
    from canopyframe.operators.colour import minmax_rescale
    return minmax_rescale(src("points"), "z", "intensity")
