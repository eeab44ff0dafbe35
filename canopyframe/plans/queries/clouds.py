"""Queries on point clouds: ground, stems, inventory, matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyframe.operators import circles, ground, hulls, inventory, selection
from canopyframe.operators.inventory import SINGLE_SCAN
from canopyframe.plans.catalog import register
from canopyframe.runtime import cut_lineage

# ---- shared oracle fragments ------------------------------------------------

GROUND_SQL = """grid as (
    select tile_id, floor(x/0.5e0) as gx, floor(y/0.5e0) as gy, quantile_cont(z, 0.02e0) as ground, count(*) as n_points
    from points group by 1, 2, 3 having count(*) >= 20)"""
HAG_SQL = GROUND_SQL + """, hags as (
    select p.*, g.ground, p.z - g.ground as hag from points p
    left join grid g on g.tile_id = p.tile_id and g.gx = floor(p.x/0.5e0) and g.gy = floor(p.y/0.5e0))"""
BAND_SQL = HAG_SQL + """, band as (
    select *, floor(x/0.04e0) as ix, floor(y/0.04e0) as iy from hags where hag between 1.0e0 and 1.6e0)"""
COMP_SQL = BAND_SQL + """, occ as (select tile_id, ix, iy, count(*) as n from band group by 1, 2, 3),
  reach as (
    select tile_id, ix, iy, ix as rx, iy as ry from occ
    union
    select r.tile_id, r.ix, r.iy, o.ix, o.iy from reach r join occ o
      on o.tile_id = r.tile_id and o.ix between r.rx - 1 and r.rx + 1 and o.iy between r.ry - 1 and r.ry + 1),
  lab as (select tile_id, ix, iy, min((rx, ry)) as comp from reach group by 1, 2, 3),
  comps as (select l.tile_id, l.ix, l.iy, o.n, l.comp, sum(o.n) over (partition by l.tile_id, l.comp) as cluster_points
    from lab l join occ o using (tile_id, ix, iy))"""
FIT_SQL = COMP_SQL + """, pts as (
    select b.*, c.comp, c.cluster_points, b.hag between 1.05e0 and 1.55e0 as narrow,
      count(*) filter (where b.hag between 1.05e0 and 1.55e0) over (partition by b.tile_id, c.comp) as n_narrow
    from band b join comps c on c.tile_id = b.tile_id and c.ix = b.ix and c.iy = b.iy where c.cluster_points >= 40),
  used as (select *, avg(x) over w as rx, avg(y) over w as ry from pts where narrow or n_narrow < 6
    window w as (partition by tile_id, comp)),
  loc as (select *, x - rx as u, y - ry as v, (x-rx)*(x-rx) + (y-ry)*(y-ry) as w from used),
  sums as (select tile_id, comp, any_value(cluster_points) as n_points, rx, ry, avg(u*u) as suu, avg(v*v) as svv,
      avg(u*v) as suv, avg(u*w) as suw, avg(v*w) as svw, avg(w) as mw from loc group by tile_id, comp, rx, ry),
  fits as (select *, (suw*svv - svw*suv)/(suu*svv - suv*suv)/2 as a, (svw*suu - suw*suv)/(suu*svv - suv*suv)/2 as c from sums),
  circ as (select tile_id, comp, n_points, rx + a as fit_x, ry + c as fit_y, sqrt(mw + a*a + c*c) as radius_m from fits),
  checked as (select c.tile_id, c.comp, c.n_points, c.fit_x, c.fit_y, c.radius_m,
      sqrt(avg((sqrt((x-fit_x)*(x-fit_x) + (y-fit_y)*(y-fit_y)) - radius_m)*(sqrt((x-fit_x)*(x-fit_x) + (y-fit_y)*(y-fit_y)) - radius_m))) as fit_rms_m,
      count(distinct least(floor((degrees(atan2(y-fit_y, x-fit_x)) + 180)/10), 35))*10 as arc_deg
    from used u join circ c on c.tile_id = u.tile_id and c.comp = u.comp group by 1, 2, 3, 4, 5, 6)"""
STEM_SQL = FIT_SQL + """, cg as (select tile_id, comp, median(ground) as cluster_ground from pts group by 1, 2),
  stems as (select k.*, coalesce(g.ground, cg.cluster_ground) as ground
    from checked k join cg on cg.tile_id = k.tile_id and cg.comp = k.comp
    left join grid g on g.tile_id = k.tile_id and g.gx = floor(k.fit_x/0.5e0) and g.gy = floor(k.fit_y/0.5e0)
    where radius_m between 0.04e0 and 0.75e0 and fit_rms_m <= 0.03e0 and arc_deg >= 90),
  ranked as (select *, row_number() over (order by -n_points, fit_rms_m, comp) as rn from stems),
  greedy as (select 0 as i, []::struct(x double, y double, rn bigint)[] as kept
    union all
    select i + 1, case when len(list_filter(kept, lambda k: (k.x-r.fit_x)*(k.x-r.fit_x) + (k.y-r.fit_y)*(k.y-r.fit_y) < 0.36e0)) > 0
      then kept else list_append(kept, {'x': r.fit_x, 'y': r.fit_y, 'rn': r.rn}) end
    from greedy join ranked r on r.rn = greedy.i + 1),
  keepers as (select unnest(kept).rn as rn from greedy where i = (select max(i) from greedy)),
  tops as (select s.rn, max(p.z) as top_z from ranked s join points p on p.tile_id = s.tile_id
    and p.x between s.fit_x - 1.5e0 and s.fit_x + 1.5e0 and p.y between s.fit_y - 1.5e0 and s.fit_y + 1.5e0
    and sqrt((p.x-s.fit_x)*(p.x-s.fit_x) + (p.y-s.fit_y)*(p.y-s.fit_y)) <= 1.5e0 group by 1),
  final as (select r.*, t.top_z - r.ground as observed, radius_m*200 as dbh_cm, pi()*radius_m*radius_m as basal_area_m2
    from ranked r join keepers using (rn) left join tops t using (rn))"""


@register("ground_model", "tile_id gx:i gy:i ground:6 n_points:i", f"with {GROUND_SQL} select * from grid", "points")
def _(src):
    return ground.ground_model(src("points"))


@register("normalize_height", "point_idx:i hag:6",
          f"with {HAG_SQL} select point_idx, hag from hags", "points")
def _(src):
    pts = src("points")
    return ground.normalize_height(pts, ground.ground_model(pts))


@register("normalize_height_default", "point_idx:i hag:6",
          """with grid as (select floor(x/2e0) as gx, floor(y/2e0) as gy, quantile_cont(z, 0.05e0) as ground
               from points group by 1, 2 having count(*) >= 5)
             select p.point_idx, p.z - coalesce(g.ground, (select median(ground) from grid)) as hag
             from points p left join grid g on g.gx = floor(p.x/2e0) and g.gy = floor(p.y/2e0)""", "points")
def _(src):
    pts = src("points")
    return ground.normalize_height(pts, ground.ground_model(pts, 2.0, 0.05, 5), 2.0, default_ground=True)


@register("radius_filter", "point_idx:i x:4 y:4 z:4",
          """select point_idx, x, y, z from points
             where sqrt((x-40.125e0)*(x-40.125e0) + (y-4.125e0)*(y-4.125e0)) <= 18.0003e0""", "points")
def _(src):
    return ground.radius_filter(src("points"), 40.125, 4.125, 18.0003)


@register("merge_scans", "scan:i n_points:i max_z:4",
          """select class as scan, count(*) as n_points, max(z) as max_z from points
             where sqrt((x-40.125e0)*(x-40.125e0) + (y-4.125e0)*(y-4.125e0)) <= 18.0003e0 group by 1""", "points")
def _(src):
    pts = src("points")
    scans = [pts.where(F.col("class") == c) for c in (0, 1, 2)]
    merged = ground.merge_scans(scans, 40.125, 4.125, 15.0003)
    return merged.groupBy(F.col("class").alias("scan")).agg(F.count(F.lit(1)).alias("n_points"), F.max("z").alias("max_z"))


@register("window_read", "class:i n_points:i max_z:4",
          """select class, count(*) as n_points, max(z) as max_z from points
             where x between 10e0 and 70e0 and y between 0e0 and 9e0 and z between -1 and 200 group by 1""", "points")
def _(src):
    cut = ground.window_read(src("points"), 10.0, 0.0, 70.0, 9.0)
    return cut.groupBy("class").agg(F.count(F.lit(1)).alias("n_points"), F.max("z").alias("max_z"))


@register("height_band", "point_idx:i hag:6", f"with {BAND_SQL} select point_idx, hag from band", "points")
def _(src):
    pts = src("points")
    return ground.height_band(ground.normalize_height(pts, ground.ground_model(pts)), 1.0, 1.6)


@register("circle_fit", "label:i n_points:i fit_x:6 fit_y:6 radius_m:6 fit_rms_m:6 arc_deg:i",
          """with used as (select *, avg(x) over w as rx, avg(y) over w as ry from points where class = 0 window w as (partition by label)),
             loc as (select *, x - rx as u, y - ry as v, (x-rx)*(x-rx) + (y-ry)*(y-ry) as w from used),
             sums as (select label, rx, ry, count(*) as n_points, avg(u*u) as suu, avg(v*v) as svv, avg(u*v) as suv,
               avg(u*w) as suw, avg(v*w) as svw, avg(w) as mw from loc group by label, rx, ry),
             fits as (select *, (suw*svv - svw*suv)/(suu*svv - suv*suv)/2 as a, (svw*suu - suw*suv)/(suu*svv - suv*suv)/2 as c from sums),
             circ as (select label, n_points, rx + a as fit_x, ry + c as fit_y, sqrt(mw + a*a + c*c) as radius_m from fits)
             select c.*, t.fit_rms_m, t.arc_deg from circ c join (
               select u.label, sqrt(avg(pow(sqrt((x-fit_x)*(x-fit_x) + (y-fit_y)*(y-fit_y)) - radius_m, 2))) as fit_rms_m,
                 count(distinct least(floor((degrees(atan2(y-fit_y, x-fit_x)) + 180)/10), 35))*10 as arc_deg
               from used u join circ c on c.label = u.label group by 1) t on t.label = c.label""", "points")
def _(src):
    return circles.fit_circles(src("points").where("class = 0"), ["label"])


@register("stem_clusters", "ix:i iy:i n:i comp_x:i comp_y:i cluster_points:i",
          f"""with recursive {COMP_SQL} select ix, iy, n, comp[1] as comp_x, comp[2] as comp_y, cluster_points
              from comps where cluster_points >= 40""", "points")
def _(src):
    pts = src("points")
    band = ground.band_above(pts, cut_lineage(ground.ground_model(pts)), *SINGLE_SCAN.band)
    return inventory.stem_clusters(band)


@register("stem_inventory", "tile_id label x:5 y:5 z:5 dbh_cm:3 basal_area_m2:6 height_m:5 volume_m3:5 "
          "observed_height_m:5 slenderness:3 fit_rms_cm:3 arc_deg:i n_points:i",
          f"""with recursive {STEM_SQL}
              select tile_id, 'Tree ' || case when no < 10 then '0' else '' end || no as label, fit_x as x, fit_y as y,
                ground + 1.3e0 as z, dbh_cm, basal_area_m2, case when observed >= 5 then observed end as height_m,
                case when observed >= 5 then basal_area_m2*observed*0.5e0 end as volume_m3,
                case when observed < 5 then observed end as observed_height_m,
                case when observed >= 5 then observed*100/dbh_cm end as slenderness,
                fit_rms_m*100 as fit_rms_cm, arc_deg, n_points
              from (select *, row_number() over (partition by tile_id order by dbh_cm desc, comp) as no from final)""",
          "points")
def _(src):
    return inventory.stem_inventory(src("points"))


@register("tree_height", "label:i top_z:5",
          """with stems as (select label, avg(x) as sx, avg(y) as sy from points where class = 0 group by 1)
             select s.label, max(p.z) as top_z from stems s join points p
               on p.x between sx - 1.5e0 and sx + 1.5e0 and p.y between sy - 1.5e0 and sy + 1.5e0
               and sqrt((p.x-sx)*(p.x-sx) + (p.y-sy)*(p.y-sy)) <= 1.5e0 group by 1""", "points")
def _(src):
    pts = src("points")
    stems = pts.where("class = 0").groupBy("tile_id", "label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return ground.tree_height(pts, stems.withColumn("stem_id", F.col("label"))).select("label", "top_z")


@register("nearest_stem", "point_idx:i label:i",
          """with grid as (select floor(x/2e0) as gx, floor(y/2e0) as gy, quantile_cont(z, 0.05e0) as ground
               from points group by 1, 2 having count(*) >= 5),
             hags as (select p.*, p.z - coalesce(g.ground, (select median(ground) from grid)) as hag
               from points p left join grid g on g.gx = floor(p.x/2e0) and g.gy = floor(p.y/2e0)),
             stems as (select label as stem_id, round(avg(x), 4) as sx, round(avg(y), 4) as sy,
                 least(greatest(0.6e0 + 0.06e0*(label % 40), 1.5e0), 4.0e0) as crown
               from points where class = 0 and label % 2 = 0 group by 1, 4),
             near as (select h.point_idx, min((sqrt((h.x-sx)*(h.x-sx) + (h.y-sy)*(h.y-sy)), stem_id, crown)) as m
               from hags h join stems s on h.x between sx - 4.1e0 and sx + 4.1e0 and h.y between sy - 4.1e0 and sy + 4.1e0
               where hag > 0.4e0 group by 1)
             select p.point_idx, case when m[1] <= least(m[3], 4.0e0) then m[2] end as label
             from points p left join near n on n.point_idx = p.point_idx""", "points")
def _(src):
    pts = src("points")
    hag = ground.normalize_height(pts, ground.ground_model(pts, 2.0, 0.05, 5), 2.0, default_ground=True)
    dbh = F.nullif((F.col("label") % 40).cast("double"), F.lit(-1.0))
    stems = (pts.where("class = 0 and label % 2 = 0").groupBy("tile_id", F.col("label").alias("stem_id"))
             .agg(F.round(F.avg("x"), 4).alias("x"), F.round(F.avg("y"), 4).alias("y"), F.max("label").alias("label")))
    stems = stems.withColumn("crown_radius_m", F.least(F.greatest(0.6 + 0.06 * dbh, F.lit(1.5)), F.lit(4.0)))
    return ground.nearest_stem(hag.drop("label"), stems.drop("label"))


@register("suppress_near", "det_id:i",
          """with recursive ranked as (select *, row_number() over (order by -n_points, fit_rms_cm, det_id) as rn from detections),
             greedy as (select 0 as i, []::struct(x double, y double, id bigint)[] as kept
               union all
               select i + 1, case when len(list_filter(kept, lambda k: sqrt((k.x-r.x)*(k.x-r.x) + (k.y-r.y)*(k.y-r.y)) < 0.6e0)) > 0
                 then kept else list_append(kept, {'x': r.x, 'y': r.y, 'id': r.det_id}) end
               from greedy join ranked r on r.rn = greedy.i + 1)
             select unnest(kept).id as det_id from greedy where i = (select max(i) from greedy)""", "detections")
def _(src):
    return selection.suppress_near(src("detections"), 0.6, [-F.col("n_points"), F.col("fit_rms_cm"), F.col("det_id")])


PAIRS_SQL = """pairs as (select ref_id, det_id, sqrt((x-ref_x)*(x-ref_x) + (y-ref_y)*(y-ref_y)) as distance_m
    from refs join detections on x between ref_x - 0.6e0 and ref_x + 0.6e0 and y between ref_y - 0.6e0 and ref_y + 0.6e0
    where sqrt((x-ref_x)*(x-ref_x) + (y-ref_y)*(y-ref_y)) <= 0.6e0)"""
MATCH_SQL = PAIRS_SQL + """, ordered as (select *, row_number() over (order by distance_m, ref_id, det_id) as rn from pairs),
  walk as (select 0 as i, []::bigint[] as ru, []::bigint[] as du, []::bigint[] as picked
    union all
    select i + 1, case when list_contains(ru, ref_id) or list_contains(du, det_id) then ru else list_append(ru, ref_id) end,
      case when list_contains(ru, ref_id) or list_contains(du, det_id) then du else list_append(du, det_id) end,
      case when list_contains(ru, ref_id) or list_contains(du, det_id) then picked else list_append(picked, rn) end
    from walk join ordered o on o.rn = walk.i + 1),
  matched as (select o.* from ordered o join (select unnest(picked) as rn from walk where i = (select max(i) from walk)) p using (rn))"""


@register("candidate_pairs", "ref_id:i det_id:i distance_m:6", f"with {PAIRS_SQL} select * from pairs", "refs detections")
def _(src):
    return selection.candidate_pairs(src("refs"), src("detections"), 0.6)


@register("greedy_match", "ref_id:i det_id:i distance_m:6", f"with recursive {MATCH_SQL} select ref_id, det_id, distance_m from matched",
          "refs detections")
def _(src):
    return selection.match_within(src("refs"), src("detections"), 0.6)


@register("detection_quality", "tp:i fn:i fp:i recall:6 precision:6 f1:6 median_error_m:6 mean_error_m:6 max_error_m:6",
          f"""with recursive {MATCH_SQL}, q as (select count(*) as tp, median(distance_m) as median_error_m,
                avg(distance_m) as mean_error_m, max(distance_m) as max_error_m,
                (select count(*) from refs) as nr, (select count(*) from detections) as nd from matched)
              select tp, nr - tp as fn, nd - tp as fp, tp/nr as recall, tp/nd as precision,
                2*(tp/nr)*(tp/nd)/((tp/nr) + (tp/nd)) as f1, median_error_m, mean_error_m, max_error_m from q""",
          "refs detections")
def _(src):
    return selection.detection_quality(src("refs"), src("detections"),
                                       selection.match_within(src("refs"), src("detections"), 0.6))


@register("match_by_position", "left_id:i right_id:i distance_m:6",
          f"with recursive {MATCH_SQL} select ref_id as left_id, det_id as right_id, distance_m from matched",
          "refs detections")
def _(src):
    left = src("refs").select(F.col("ref_id").alias("tree_id"), F.col("ref_x").alias("x"), F.col("ref_y").alias("y"))
    right = src("detections").withColumnRenamed("det_id", "tree_id")
    return selection.match_by_position(left, right, 0.6)


@register("max_pair_distance", "stand_id:i span_m:6",
          """select a.stand_id, max(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y))) as span_m
             from trees a join trees b on a.stand_id = b.stand_id group by 1""", "trees")
def _(src):
    return hulls.max_pair_distance(src("trees"), ["stand_id"])


def _plot_sql() -> str:
    """The stem oracle with the thresholds of the merged-plot flavour, on the cut cloud."""
    text = STEM_SQL
    for old, new in (("0.02e0) as ground", "0.05e0) as ground"), (">= 20)", ">= 15)"), ("between 1.0e0 and 1.6e0", "between 0.7e0 and 2.0e0"),
                     ("between 1.05e0 and 1.55e0", "between 1.1e0 and 1.5e0"), ("n_narrow < 6", "n_narrow < 8"),
                     ("between 0.04e0 and 0.75e0", "between 0.03e0 and 0.80e0"), ("arc_deg >= 90", "arc_deg >= 80 and g.ground is not null"),
                     ("coalesce(g.ground, cg.cluster_ground)", "g.ground"), ("< 0.36e0", "< 0.25e0"),
                     ("from points", "from plot"), ("join points", "join plot")):
        if old not in text:
            raise ValueError(f"oracle fragment changed: {old}")
        text = text.replace(old, new)
    return "plot as (select * from points where sqrt((x-18.1e0)*(x-18.1e0) + (y-2.1e0)*(y-2.1e0)) <= 18.0e0), " + text


@register("plot_summary", "n_stems:i stems_per_ha:3 basal_area_m2_ha:5 dbh_mean_cm:4 dg_cm:4 height_mean_m:4 stock_m3_ha:4 n_heights:i sdi:2 structure",
          f"""with recursive {_plot_sql()}, s as (select count(*) as n_stems, sum(basal_area_m2) as ba, avg(dbh_cm) as dbh_mean_cm, sqrt(avg(dbh_cm*dbh_cm)) as dg_cm,
                avg(case when observed > 3 then observed end) as height_mean_m, sum(case when observed > 3 then basal_area_m2*observed*0.5e0 end) as stock,
                count(case when observed > 3 then 1 end) as n_heights, stddev_pop(dbh_cm) as sd, pi()*225/10000 as ha
                from final where sqrt((fit_x-18.1e0)*(fit_x-18.1e0) + (fit_y-2.1e0)*(fit_y-2.1e0)) <= 15 group by tile_id)
              select n_stems, n_stems/ha as stems_per_ha, ba/ha as basal_area_m2_ha, dbh_mean_cm, dg_cm, height_mean_m, stock/ha as stock_m3_ha, n_heights,
                n_stems/ha*pow(dg_cm/25, 1.605e0) as sdi, case when sd < 10 then 'single-layered' else 'multi-layered' end as structure from s""", "points")
def _(src):
    pts = src("points")
    scans = [pts.where(F.col("class") == c).select("tile_id", "point_idx", "x", "y", "z") for c in (0, 1, 2)]
    stems = inventory.plot_inventory(scans, (18.1, 2.1))
    return inventory.stand_summary(stems, inventory.plot_area_ha(15.0), ["tile_id"])


@register("plot_center", "center_x:6 center_y:6", "select avg(tx) as center_x, avg(ty) as center_y from cameras", "cameras")
def _(src):
    return inventory.plot_center(src("cameras"))
