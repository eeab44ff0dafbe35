"""Queries on pixel tables and cameras."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyframe.functions import colour, geometry
from canopyframe.operators import cameras as cam
from canopyframe.operators import colour as colours
from canopyframe.operators import pixels as px
from canopyframe.operators import rasters
from canopyframe.plans.catalog import register

CROWN = "not (((r+g+b)/3e0 >= 140 and b-r > 6 and b-g > 6) or (r+g+b)/3e0 <= 18)"
SKY = """(greatest(r,g,b) > 140 and ((b >= r and b >= g) or (case when greatest(r,g,b) > 0 then
  (greatest(r,g,b) - least(r,g,b))/cast(greatest(r,g,b) as double) else 0 end) < 0.20e0))"""


@register("rgb_indices", "image_id:i row:i col:i exg:6 gli:6 vari:6",
          """select image_id, row, col, (2*g - r - b)/(r + g + b + 1e-6) as exg, (2*g - r - b)/(2*g + r + b + 1e-6) as gli,
               (g - r)/cast(nullif(g + r - b, 0) as double) as vari from pixels""", "pixels")
def _(src):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return src("pixels").select("image_id", "row", "col", colour.exg(r, g, b).alias("exg"), colour.gli(r, g, b).alias("gli"),
                                colour.vari(r, g, b).alias("vari"))


@register("pixel_masks", "image_id:i row:i col:i sky:b shadow:b crown:b hemi_sky:b",
          f"""select image_id, row, col, (r+g+b)/3e0 >= 140 and b-r > 6 and b-g > 6 as sky, (r+g+b)/3e0 <= 18 as shadow,
                {CROWN} as crown, {SKY} as hemi_sky from pixels""", "pixels")
def _(src):
    c = [F.col(x) for x in ("r", "g", "b")]
    return src("pixels").select("image_id", "row", "col", colour.bright_sky(*c).alias("sky"), colour.deep_shadow(*c).alias("shadow"),
                                colour.crown(*c).alias("crown"), colour.hemisphere_sky(*c).alias("hemi_sky"))


@register("pseudo_ndvi", "image_id:i row:i col:i ndvi:6",
          "select image_id, row, col, case when r + g >= 40 then (r - g)/(r + g + 1e-6) end as ndvi from pixels", "pixels")
def _(src):
    return src("pixels").select("image_id", "row", "col", colour.pseudo_ndvi(F.col("r"), F.col("g")).alias("ndvi"))


@register("ndvi_summary", "median:6 p90:6 nodata_pct:6",
          """with v as (select case when r + g >= 40 then (r - g)/(r + g + 1e-6) end as ndvi from pixels)
             select median(ndvi) as median, quantile_cont(ndvi, 0.9e0) as p90, 100*avg(case when ndvi is null then 1e0 else 0e0 end) as nodata_pct from v""",
          "pixels")
def _(src):
    return px.ndvi_summary(src("pixels"))


@register("panoptic_decode", "image_id:i row:i col:i segment_id:i",
          "select image_id, row, col, r + 256*g + 65536*b as segment_id from pixels", "pixels")
def _(src):
    return px.decode_segments(src("pixels")).select("image_id", "row", "col", "segment_id")


@register("annotate_segments", "category n_pixels:i n_segments:i",
          """with p as (select image_id, r % 4 as segment_id from pixels),
             s as (select image_id, segment_id, case segment_id when 0 then 'spruce' when 1 then 'pine' else 'birch' end as category
               from p where segment_id < 3 group by 1, 2)
             select category, count(*) as n_pixels, count(distinct (image_id, segment_id)) as n_segments
             from p join s using (image_id, segment_id) group by 1""", "pixels")
def _(src):
    p = src("pixels").select("image_id", "row", "col", (F.col("r") % 4).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    seg = p.where("r < 3").groupBy("image_id", F.col("r").alias("segment_id")).agg(F.count(F.lit(1)).alias("n"))
    seg = seg.select("image_id", "segment_id", F.when(F.col("segment_id") == 0, "spruce").when(F.col("segment_id") == 1, "pine")
                     .otherwise("birch").alias("category"))
    return px.annotate_segments(p, seg).groupBy("category").agg(
        F.count(F.lit(1)).alias("n_pixels"), F.countDistinct("image_id", "segment_id").alias("n_segments"))


@register("crop_color_stats", "image_id:i exg_mean:6 gli_mean:6 green_share:6 nongreen_share:6 n_pixels:i",
          f"""with c as (select image_id, (2*g - r - b)/(r + g + b + 1e-6) as exg, (2*g - r - b)/(2*g + r + b + 1e-6) as gli
                from pixels where {CROWN})
              select image_id, avg(exg) as exg_mean, avg(gli) as gli_mean, avg(case when gli >= 0.02e0 then 1e0 else 0e0 end) as green_share,
                1 - avg(case when gli >= 0.02e0 then 1e0 else 0e0 end) as nongreen_share, count(*) as n_pixels
              from c group by 1 having count(*) >= 16""", "pixels")
def _(src):
    return px.crop_colour_stats(src("pixels"), ["image_id"])


@register("glcm_texture", "image_id:i contrast:6 homogeneity:6 energy:10 entropy:6 correlation:5",
          f"""with q as (select image_id, row, col, least(floor((r+g+b)/3e0/256*16), 15) as q from pixels where {CROWN}),
              d as (select * from (values (0, 1), (-1, 1), (-1, 0), (-1, -1)) as t(dy, dx)),
              p as (select a.image_id, a.q as i, b.q as j from q a cross join d join q b on b.image_id = a.image_id
                and b.row = a.row + dy and b.col = a.col + dx),
              s as (select image_id, i, j, count(*) as c from (select image_id, i, j from p union all select image_id, j, i from p) group by 1, 2, 3),
              t as (select *, c/sum(c) over w as pr, sum(c) over w as t, sum(i*c) over w/sum(c) over w as mu from s window w as (partition by image_id)),
              v as (select *, sum((i-mu)*(i-mu)*pr) over (partition by image_id) as var from t where t >= 32)
              select image_id, sum((i-j)*(i-j)*pr) as contrast, sum(pr/(1 + (i-j)*(i-j))) as homogeneity, sum(pr*pr) as energy,
                -sum(pr*log2(pr)) as entropy, case when max(var) < 1e-12 then 0 else sum((i-mu)*(j-mu)*pr)/max(var) end as correlation
              from v group by 1""", "pixels")
def _(src):
    return px.glcm_texture(src("pixels"), ["image_id"])


@register("multiview_mean", "marker_id:i green_share:6 gli:6 n_views:i",
          "select marker_id, avg(green_share) as green_share, avg(gli) as gli, count(*) as n_views from views group by 1", "views")
def _(src):
    return px.multiview_mean(src("views"), "marker_id", ["green_share", "gli"])


@register("multiview_vote", "marker_id:i verdict n_votes:i",
          """select marker_id, verdict, n as n_votes from (select *, row_number() over (partition by marker_id order by n desc, verdict) as rn
               from (select marker_id, verdict, count(*) as n from views group by 1, 2)) where rn = 1""", "views")
def _(src):
    return px.multiview_vote(src("views"), "marker_id", "verdict")


@register("gap_fraction", "image_id:i gap_fraction:6 sky_fraction:6",
          f"""with w as (select *, 90 - (row + 0.5e0)/8*180 as lat, greatest(cos(radians(90 - (row + 0.5e0)/8*180)), 0) as w,
                case when {SKY} then 1e0 else 0e0 end as sky from pixels)
              select image_id, sum(case when lat > 0 then w*sky else 0 end)/sum(case when lat > 0 then w else 0 end) as gap_fraction,
                sum(w*sky)/sum(w) as sky_fraction from w group by 1""", "pixels")
def _(src):
    return px.gap_fraction(src("pixels"), 8)


@register("greenness", "image_id:i vari:6 gli:6 exg:6",
          f"""select image_id, avg((g - r)/cast(nullif(g + r - b, 0) as double)) filter (where not {SKY}) as vari,
                avg((2*g - r - b)/cast(nullif(2*g + r + b, 0) as double)) filter (where not {SKY}) as gli,
                avg((2*g - r - b)/cast(greatest(r + g + b, 1) as double)) filter (where not {SKY}) as exg from pixels group by 1""", "pixels")
def _(src):
    return px.greenness(src("pixels"))


@register("sun_position", "image_id:i azimuth_deg:3 elevation_deg:3 confidence:5",
          """with l as (select image_id, row, col, round(0.299e0*r + 0.587e0*g + 0.114e0*b, 6) as lum from pixels),
             m as (select image_id, median(lum) as med from l group by 1),
             p as (select * from (select *, row_number() over (partition by image_id order by lum desc, row, col) as rn from l) where rn = 1)
             select p.image_id, ((col + 0.5e0)/8*360 - 180 + 360) % 360 as azimuth_deg, 90 - (row + 0.5e0)/8*180 as elevation_deg,
               least(greatest((lum - med)/255, 0)*(lum/255)*1.6e0, 1) as confidence from p join m using (image_id)""", "pixels")
def _(src):
    return px.sun_position(src("pixels"), 8, 8)


OTSU = """lev as (select *, floor(pow(b/255e0, 2.2e0)*255 + 0.5e0) as level from pixels),
  hist as (select image_id, level, count(*) as n from lev group by 1, 2),
  cum as (select *, sum(n) over w as n0, sum(n*level) over w as s0, sum(n) over (partition by image_id) as nn,
    sum(n*level) over (partition by image_id) as ss from hist window w as (partition by image_id order by level)),
  var as (select image_id, level, round(case when nn > n0 then cast(n0 as double)/nn*(nn-n0)/nn*(s0/n0 - (ss-s0)/(nn-n0))*(s0/n0 - (ss-s0)/(nn-n0)) else -1 end, 9) as v from cum),
  otsu as (select image_id, level as threshold from (select *, row_number() over (partition by image_id order by v desc, level) as rn from var) where rn = 1)"""
GAPS = OTSU + """, gaps as (select image_id, floor(t/10) as ring, floor(az/45) as segment, avg(case when level > threshold then 1e0 else 0e0 end) as gap, count(*) as n_pixels
    from (select l.image_id, l.level, o.threshold, sqrt((col+0.5e0-4)*(col+0.5e0-4) + (row+0.5e0-4)*(row+0.5e0-4))/4*90 as t,
      (degrees(atan2(row+0.5e0-4, col+0.5e0-4)) + 360) % 360 as az from lev l join otsu o using (image_id)) where t < 70 group by 1, 2, 3)"""


@register("otsu_threshold", "image_id:i threshold:i", f"with {OTSU} select * from otsu", "pixels")
def _(src):
    return px.otsu_threshold(src("pixels"), ["image_id"])


@register("ring_gap_fraction", "image_id:i ring:i segment:i gap:6 n_pixels:i", f"with {GAPS} select * from gaps", "pixels")
def _(src):
    p = src("pixels")
    return px.ring_gaps(p, px.otsu_threshold(p, ["image_id"]), ["image_id"], 8)


@register("canopy_lai", "image_id:i lai_effective:5 lai:5 openness_pct:5 clumping:5",
          f"""with {GAPS}, f as (select *, greatest(gap, 0.5e0/n_pixels) as g from gaps),
              r as (select image_id, ring, avg(g) as g, -avg(ln(g)) as nl, sin(radians((ring+0.5e0)*10)) as w, cos(radians((ring+0.5e0)*10)) as ct from f group by 1, 2),
              o as (select image_id, 2*sum(-ln(g)*ct*w)/sum(w) as lai_effective, 2*sum(nl*ct*w)/sum(w) as lai,
                100*sum(g*ct*w)/sum(ct*w) as openness_pct from r group by 1)
              select *, lai_effective/nullif(lai, 0) as clumping from o""", "pixels")
def _(src):
    p = src("pixels")
    return px.canopy_lai(px.ring_gaps(p, px.otsu_threshold(p, ["image_id"]), ["image_id"], 8), ["image_id"])


@register("color_transfer", "image_id:i row:i col:i tr:4 tg:4 tb:4",
          """with s as (select avg(r) as mr, stddev_pop(r) + 1e-6 as sr, avg(g) as mg, stddev_pop(g) + 1e-6 as sg, avg(b) as mb,
               stddev_pop(b) + 1e-6 as sb from pixels)
             select image_id, row, col, least(greatest((r-mr)*(41e0/sr) + 120, 0), 255) as tr, least(greatest((g-mg)*(38e0/sg) + 110, 0), 255) as tg,
               least(greatest((b-mb)*(35e0/sb) + 95, 0), 255) as tb from pixels, s""", "pixels")
def _(src):
    return colours.colour_transfer(src("pixels"), [120.0, 110.0, 95.0], [41.0, 38.0, 35.0])


SEG_SQL = """seg as (select *, floor((0.299e0*r + 0.587e0*g + 0.114e0*b) + 0.5e0) as grey, greatest(r,g,b) as mx, least(r,g,b) as mn from pixels),
  ins as (select * from seg where (r + g) % 5 > 0),
  hsv as (select *, case when mx = mn then 0e0 else (case when mx = r then ((g-b)*60e0/(mx-mn) + case when g < b then 360 else 0 end)
      when mx = g then (b-r)*60e0/(mx-mn) + 120 else (r-g)*60e0/(mx-mn) + 240 end)/2 end as hue,
    case when mx = 0 then 0e0 else (mx-mn)*255e0/mx end as sat, (r+g+b)/3e0 as bright, r + g + b + 1e-6 as s from ins),
  st as (select image_id, avg(r) as r_mean, stddev_pop(r) as r_std, avg(g) as g_mean, stddev_pop(g) as g_std, avg(b) as b_mean, stddev_pop(b) as b_std,
    avg(hue) as hue_mean, stddev_pop(hue) as hue_std, avg(sat) as sat_mean, stddev_pop(sat) as sat_std, avg(mx) as val_mean, stddev_pop(mx) as val_std,
    quantile_cont(bright, 0.1e0) as bright_p10, quantile_cont(bright, 0.5e0) as bright_p50, quantile_cont(bright, 0.9e0) as bright_p90,
    avg(r/s) as r_share, avg(g/s) as g_share, avg(b/s) as b_share, avg(r/(g+1e-6)) as rg_ratio, avg(b/(g+1e-6)) as bg_ratio, count(*) as n_pixels, min(row) as y0, max(row) as y1, min(col) as x0, max(col) as x1
    from hsv group by 1 having count(*) >= 20),
  k as (select * from (values (-1,-1,-1,-1), (-1,0,0,-2), (-1,1,1,-1), (0,-1,-2,0), (0,1,2,0), (1,-1,-1,1), (1,0,0,2), (1,1,1,1)) as t(dy,dx,wx,wy)),
  w as (select i.image_id, i.row as r0, i.col as c0, wx, wy, y0, y1, x0, x1,
    case when i.row+dy < y0 then 2*y0 - (i.row+dy) when i.row+dy > y1 then 2*y1 - (i.row+dy) else i.row+dy end as rr,
    case when i.col+dx < x0 then 2*x0 - (i.col+dx) when i.col+dx > x1 then 2*x1 - (i.col+dx) else i.col+dx end as cc
    from ins i join st using (image_id) cross join k),
  g as (select w.image_id, r0, c0, sum(wx*grey) as gx, sum(wy*grey) as gy from w join seg s on s.image_id = w.image_id and s.row = w.rr and s.col = w.cc group by 1, 2, 3),
  m as (select *, sqrt(gx*gx + gy*gy) as mag, avg(sqrt(gx*gx + gy*gy)) over (partition by image_id) as gm from g),
  e as (select image_id, avg(mag) as grad_mean, stddev_pop(mag) as grad_std, avg(abs(gx))/(avg(abs(gy)) + 1e-6) as grad_xy_ratio,
    avg(case when mag > gm then 1e0 else 0e0 end) as edge_share from m group by 1)"""


#: Ratios of channels may be near a million where the other channel is 0.
_DIGITS = {"rg_ratio": 2, "bg_ratio": 2}


@register("segment_features", "image_id:i n_pixels:i " + " ".join(f"{n}:{_DIGITS.get(n, 5)}" for n in px.FEATURE_NAMES),
          f"with {SEG_SQL} select st.*, e.grad_mean, e.grad_std, e.grad_xy_ratio, e.edge_share from st join e using (image_id)", "pixels")
def _(src):
    return px.segment_features(src("pixels"), ["image_id"], (F.col("r") + F.col("g")) % 5 > 0)


# ---- cameras --------------------------------------------------------------------

QUAT = """cam as (select *, 1 - 2*qz*qz as r00, -2*qz*qw as r01, 2*qz*qw as r10, 1 - 2*qz*qz as r11, 400e0 as fx, 400e0 as fy, 320e0 as cx, 240e0 as cy,
    640 as width, 480 as height from cameras)"""


def _cameras(src):
    """Upright cameras turned so that they look along the horizon."""
    half = 0.7071067811865476
    q = [F.col("qw"), F.col("qz")]
    # multiply the yaw rotation with a quarter turn about x: the view axis becomes horizontal
    base = src("cameras").withColumns({"_w": q[0] * half, "_x": q[0] * half, "_y": q[1] * half, "_z": q[1] * half})
    base = base.withColumns({"qw": F.col("_w"), "qx": F.col("_x"), "qy": F.col("_y"), "qz": F.col("_z")}).drop("_w", "_x", "_y", "_z")
    posed = cam.pose_to_extrinsics(base)
    return posed.withColumns({"fx": F.lit(400.0), "fy": F.lit(400.0), "cx": F.lit(320.0), "cy": F.lit(240.0),
                              "width": F.lit(640), "height": F.lit(480)})


# after the quarter turn about x: right = (c, s, 0), up = (0, 0, 1), back = (s, -c, 0) with c, s of the yaw
VIEW = """cam as (select camera_id, tx, ty, tz, qw*qw - qz*qz as c, 2*qw*qz as s from cameras),
  vis as (select p.*, camera_id, 320 + 400*((p.x-tx)*c + (p.y-ty)*s)/d as u, 240 - 400*(p.z-tz)/d as v, d as depth
    from (select p.*, k.*, -((p.x-tx)*s - (p.y-ty)*c) as d from {points} p cross join cam k) p
    where d > {depth} and 320 + 400*((p.x-tx)*c + (p.y-ty)*s)/d >= {margin} and 320 + 400*((p.x-tx)*c + (p.y-ty)*s)/d < 640 - {margin}
      and 240 - 400*(p.z-tz)/d >= {margin} and 240 - 400*(p.z-tz)/d < 480 - {margin})"""


@register("pose_to_extrinsics", "camera_id:i ew:6 ex:6 ey:6 ez:6 px:5 py:5 pz:5",
          """with r as (select *, qw*qw - qz*qz as c, 2*qw*qz as s from cameras)
             select camera_id, 0e0 as ew, case when c > 0 then abs(qw) else qw*sign(qz) end as ex,
               case when c > 0 then qz*sign(qw) else abs(qz) end as ey, 0e0 as ez,
               -(c*tx + s*ty) as px, -(s*tx - c*ty) as py, tz as pz from r""", "cameras")
def _(src):
    return cam.pose_to_extrinsics(src("cameras"))


@register("project_points", "tree_id:i camera_id:i u:4 v:4 depth:5",
          "with t as (select tree_id, x*0.2e0 + 0.0137e0 as x, y*0.2e0 + 0.0071e0 as y, 1.3e0 as z from trees), "
          + VIEW.format(points="t", depth="1e-3", margin="0e0") + " select tree_id, camera_id, u, v, depth from vis", "trees cameras")
def _(src):
    return cam.visible(_view_trees(src), _cameras(src))


def _view_trees(src):
    return src("trees").select("tree_id", "dbh_cm", (F.col("x") * 0.2 + 0.0137).alias("x"), (F.col("y") * 0.2 + 0.0071).alias("y"),
                               F.lit(1.3).alias("z"))


@register("best_view", "tree_id:i camera_id:i depth:5 u:4 v:4",
          "with t as (select tree_id, x*0.2e0 + 0.0137e0 as x, y*0.2e0 + 0.0071e0 as y, 1.3e0 as z from trees), "
          + VIEW.format(points="t", depth="0.5e0", margin="40e0")
          + """ select tree_id, camera_id, depth, u, v from (select *, row_number() over (partition by tree_id order by round(depth, 9), camera_id) as rn
                from vis) where rn = 1""", "trees cameras")
def _(src):
    return cam.best_view(_view_trees(src), _cameras(src))


@register("bark_boxes", "tree_id:i x0:i x1:i y0:i y1:i",
          "with t as (select tree_id, dbh_cm, x*0.2e0 + 0.0137e0 as x, y*0.2e0 + 0.0071e0 as y, 1.3e0 as z from trees), "
          + VIEW.format(points="t", depth="0.5e0", margin="40e0")
          + """, b as (select *, 400*(dbh_cm/100)/depth as sp from (select *, row_number() over (partition by tree_id order by round(depth, 9), camera_id) as rn
                from vis) where rn = 1),
               h as (select *, greatest(floor(sp*0.40e0), 4) as hw, greatest(floor(sp*1.4e0), 10) as hh from b),
               x as (select tree_id, greatest(floor(u) - hw, 0) as x0, least(floor(u) + hw, 640) as x1, greatest(floor(v) - hh, 0) as y0,
                 least(floor(v) + hh, 480) as y1 from h)
               select * from x where x1 - x0 >= 6 and y1 - y0 >= 12""", "trees cameras")
def _(src):
    trees = _view_trees(src)
    views = cam.best_view(trees, _cameras(src)).join(trees.select("tree_id", "dbh_cm"), "tree_id")
    return cam.bark_boxes(views, 640, 480, F.lit(400.0))


@register("bark_pixels", "tree_id:i n_pixels:i mean_r:5",
          """with b as (select c_custkey as tree_id, c_custkey % 25 as camera_id, c_custkey % 5 as x0, c_custkey % 5 + 3 as x1,
               c_nationkey % 4 as y0, c_nationkey % 4 + 4 as y1 from customer)
             select tree_id, count(*) as n_pixels, avg(r) as mean_r from b join pixels p on p.image_id = b.camera_id
               and p.col >= x0 and p.col < x1 and p.row >= y0 and p.row < y1 group by 1""", "pixels trees")
def _(src):
    t = src("trees")
    boxes = t.select("tree_id", (F.col("tree_id") % 25).alias("camera_id"), (F.col("tree_id") % 5).alias("x0"),
                     (F.col("tree_id") % 5 + 3).alias("x1"), (F.col("stand_id") % 4).alias("y0"), (F.col("stand_id") % 4 + 4).alias("y1"))
    return cam.box_pixels(boxes, src("pixels")).groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_pixels"), F.avg("r").alias("mean_r"))


@register("crop_geometry", "marker_key:i pitch:4 fov:4",
          """with m as (select marker_key, dy*8 as pitch, dx as dist, height_m*3 as h from markers),
             k as (select *, dist > 0.5e0 and h <> 0 as ok, degrees(atan(h/2/dist)) as half from m),
             f as (select *, least(greatest(half*2*1.4e0, 12), 70) as v from k)
             select marker_key, case when ok then least(greatest(pitch + least(v/2, half), -85), 85) else pitch end as pitch,
               case when ok then v else 25 end as fov from f""", "markers")
def _(src):
    p, f = geometry.crop_window(F.col("dy") * 8, F.col("dx"), F.col("height_m") * 3)
    return src("markers").select("marker_key", p.alias("pitch"), f.alias("fov"))


CROP_MARKERS = """mk as (select vec_id as marker_id, vec_id as image_id, (vec_id*37) % 360 - 180 + 0.37e0 as yaw, (vec_id*11) % 120 - 60 + 0.13e0 as pitch,
    57e0 as fov from embeddings)"""


def _crop_markers(src):
    ids = src("pixels").select(F.col("image_id")).where("row = 0 and col = 0")
    return ids.select(F.col("image_id").alias("marker_id"), "image_id", ((F.col("image_id") * 37) % 360 - 180 + 0.37).alias("yaw"),
                      ((F.col("image_id") * 11) % 120 - 60 + 0.13).alias("pitch"), F.lit(57.0).alias("hfov"), F.lit(57.0).alias("vfov"))


@register("crown_crop", "marker_id:i crop_row:i crop_col:i r:i g:i b:i",
          f"""with {CROP_MARKERS}, dir as (select *, cos(radians(pitch))*cos(radians(yaw)) as c0, cos(radians(pitch))*sin(radians(yaw)) as c1,
                sin(radians(pitch)) as c2, -sin(radians(yaw)) as r0, cos(radians(yaw)) as r1 from mk),
              up as (select *, -c2*r1 as u0, c2*r0 as u1, c0*r1 - c1*r0 as u2 from dir),
              ray as (select *, i // 6 as crop_row, i % 6 as crop_col, ((i % 6 + 0.5e0)/6*2 - 1)*tan(radians(fov)/2) as a,
                (1 - (i // 6 + 0.5e0)/6*2)*tan(radians(fov)/2) as bb from up cross join range(36) as t(i)),
              d as (select *, c0 + a*r0 + bb*u0 as dx, c1 + a*r1 + bb*u1 as dy, c2 + bb*u2 as dz from ray),
              h as (select *, round_even((atan2(dy, dx) + pi())/(2*pi())*8 - 0.5e0, 0) as col0,
                round_even((pi()/2 - asin(dz/sqrt(dx*dx + dy*dy + dz*dz)))/pi()*8 - 0.5e0, 0) as row0 from d)
              select h.marker_id, crop_row, crop_col, p.r, p.g, p.b from h join pixels p on p.image_id = h.image_id
                and p.col = cast((col0 + 8) % 8 as int) and p.row = cast(least(greatest(row0, 0), 7) as int)""", "pixels")
def _(src):
    return cam.crown_crop(_crop_markers(src), _tiles(src, True), 6, 8, 8, _SIDE)


#: Images of the carrier are 8 x 8; smaller tiles let samples cross from one to the next.
_SIDE = 4


def _tiles(src, wrap):
    return rasters.pixel_tiles(src("pixels"), 8, 8, wrap, _SIDE)


@register("zenith_fisheye", "image_id:i out_row:i out_col:i r:4 g:4 b:4",
          """with ray as (select vec_id as image_id, i // 8 as out_row, i % 8 as out_col, (i % 8 + 0.5e0)/8*2 - 1 as dx, (i // 8 + 0.5e0)/8*2 - 1 as dy
               from embeddings cross join range(64) as t(i)),
             pol as (select *, (atan2(dy, dx)/(2*pi()) + 0.5e0) as turn, sqrt(dx*dx + dy*dy) as rr from ray),
             pos as (select *, (turn - floor(turn))*8 - 0.5e0 as x, rr*radians(90)/pi()*8 - 0.5e0 as y from pol where rr <= 1),
             cl as (select *, floor(x) as x0, least(greatest(floor(y), 0), 6) as y0 from pos),
             tap as (select image_id, out_row, out_col, (x0 + j + 8) % 8 as col, y0 + k as row,
               (case when j = 1 then x - x0 else 1 - (x - x0) end)*(case when k = 1 then y - y0 else 1 - (y - y0) end) as w
               from cl cross join range(2) as a(j) cross join range(2) as b(k))
             select t.image_id, out_row, out_col, least(greatest(sum(w*r), 0), 255) as r, least(greatest(sum(w*g), 0), 255) as g,
               least(greatest(sum(w*b), 0), 255) as b
             from tap t join pixels p on p.image_id = t.image_id and p.row = t.row and p.col = t.col group by 1, 2, 3""", "pixels")
def _(src):
    p = src("pixels")
    return cam.zenith_fisheye(p.where("row = 0 and col = 0"), _tiles(src, True), 8, 8, 8, side=_SIDE)


BLEND = """k as (select camera_id // 5 as pano_id, camera_id as image_id, qw*qw - qz*qz as c, 2*qw*qz as s from cameras),
             ray as (select k.*, i // 32 as out_row, i % 32 as out_col, (i % 32 + 0.5e0)/32*2*pi() - pi() as lon, pi()/2 - (i // 32 + 0.5e0)/16*pi() as lat
               from k cross join range(512) as t(i)),
             d as (select *, cos(lat)*cos(lon)*(-s) + cos(lat)*sin(lon)*c as al, cos(lat)*cos(lon)*c + cos(lat)*sin(lon)*s as a, sin(lat) as bb from ray),
             uv as (select *, 4 + 5*(a/al) as u, 4 - 5*(bb/al) as v from d where al > 1e-6),
             tap as (select *, pow(least(al, 1), 3) as w from uv where u >= 0 and u < 8 and v >= 0 and v < 8)"""


@register("pano_blend", "pano_id:i out_row:i out_col:i r:3 g:3 b:3",
          f"""with {BLEND}
             select pano_id, out_row, out_col, sum(w*r)/sum(w) as r, sum(w*g)/sum(w) as g, sum(w*b)/sum(w) as b
             from tap t join pixels p on p.image_id = t.image_id and p.row = floor(v) and p.col = floor(u)
             where (r + g + b)/3e0 > 8 group by 1, 2, 3""", "pixels cameras")
def _(src):
    return cam.pano_blend(_blend_cameras(src), _tiles(src, False), 32, 8, 8, side=_SIDE)


def _blend_cameras(src):
    return _cameras(src).select(F.floor(F.col("camera_id") / 5).alias("pano_id"), F.col("camera_id").alias("image_id"), "qw", "qx", "qy", "qz",
                                F.lit(5.0).alias("fpx"), F.lit(4.0).alias("cx"), F.lit(4.0).alias("cy"))


@register("pano_coverage", "pano_id:i coverage_pct:4",
          f"""with {BLEND} select pano_id, count(distinct (out_row, out_col))*100e0/512 as coverage_pct
             from tap t join pixels p on p.image_id = t.image_id and p.row = floor(v) and p.col = floor(u)
             where (r + g + b)/3e0 > 8 group by 1""", "pixels cameras")
def _(src):
    return cam.coverage(cam.pano_blend(_blend_cameras(src), _tiles(src, False), 32, 8, 8, side=_SIDE), ["pano_id"], 32, 16)


@register("assignment_share", "class:i n_points:i n_assigned:i share_pct:6 trees_hit:i",
          """with l as (select class, case when point_idx % 3 > 0 then label end as label from points)
             select class, count(*) as n_points, count(label) as n_assigned, 100*avg(case when label is null then 0e0 else 1e0 end) as share_pct,
               count(distinct label) as trees_hit from l group by 1""", "points")
def _(src):
    return cam.assignment_share(src("points").withColumn("label", F.when(F.col("point_idx") % 3 > 0, F.col("label"))), ["class"])


@register("zbuffer_render", "camera_id:i row:i col:i r:i g:i b:i",
          "with t as (select tree_id as point_idx, tree_id % 256 as r, tree_id % 251 as g, tree_id % 241 as b, x*0.2e0 + 0.0137e0 as x, y*0.2e0 + 0.0071e0 as y, 1.3e0 as z from trees), "
          + VIEW.format(points="t", depth="1e-3", margin="0e0")
          + """, dots as (select camera_id, depth, point_idx, r, g, b, least(greatest(floor(v) + dv, 0), 479) as row, least(greatest(floor(u) + du, 0), 639) as col
                from vis cross join (select i - 2 as dv from range(5) as q(i)) cross join (select i - 2 as du from range(5) as q(i)))
               select camera_id, row, col, r, g, b from (select *, row_number() over (partition by camera_id, row, col order by round(depth, 9), point_idx) as rn from dots)
               where rn = 1""", "trees cameras")
def _(src):
    t = src("trees").select(F.col("tree_id").alias("point_idx"), (F.col("tree_id") % 256).alias("r"), (F.col("tree_id") % 251).alias("g"),
                            (F.col("tree_id") % 241).alias("b"), (F.col("x") * 0.2 + 0.0137).alias("x"), (F.col("y") * 0.2 + 0.0071).alias("y"),
                            F.lit(1.3).alias("z"))
    return cam.zbuffer_render(t, _cameras(src))


@register("rasterize_view", "row:i col:i r:i g:i b:i",
          """with e as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from points),
             s as (select point_idx, r, g, b, floor((x-x0)/greatest(x1-x0, 1e-6)*639) as col, 639 - floor((y-y0)/greatest(y1-y0, 1e-6)*639) as row from points, e)
             select row, col, r, g, b from (select *, row_number() over (partition by row, col order by point_idx desc) as rn from s) where rn = 1""", "points")
def _(src):
    return cam.rasterize_view(src("points"), ["tile_id"], 640, 640)


@register("standpoints", "camera_id:i pos_x:4 pos_y:4 pos_z:4 distance_m:5",
          """select camera_id, tx - 1.5e0 as pos_x, tz - 0.5e0 as pos_y, -(ty - 2.5e0) as pos_z,
               sqrt((tx-1.5e0)*(tx-1.5e0) + (tz-0.5e0)*(tz-0.5e0) + (ty-2.5e0)*(ty-2.5e0)) as distance_m from cameras""", "cameras")
def _(src):
    return cam.standpoints(src("cameras"), (1.5, 2.5, 0.5))
