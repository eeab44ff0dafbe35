"""Queries on rasters, hedges, structure, suitability and geographic context."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyframe import dims
from canopyframe.functions import colour
from canopyframe.operators import colour as colours
from canopyframe.operators import pixels as px
from canopyframe.operators import provenance as prov
from canopyframe.operators import structure
from canopyframe.operators.components import connected_components
from canopyframe.plans.catalog import register


def _chm(src):
    cells = src("cells")
    tile = F.col("tile_id") if "tile_id" in cells.columns else F.lit("c0").alias("tile_id")
    return cells.select(tile, F.col("cx").alias("ix"), F.col("cy").alias("iy"), F.col("value").alias("height"))


def components_sql(name: str, nodes: str) -> str:
    """Smallest id of each 4-connected component; ``nodes`` has ``id, ix, iy, scope``."""
    return f"""{name}_e as materialized (select a.id as a, b.id as b from (select n.*, s.dx, s.dy from {nodes} n
        cross join (values (1, 0), (-1, 0), (0, 1), (0, -1)) as s(dx, dy)) a
      join {nodes} b on b.scope = a.scope and b.ix = a.ix + a.dx and b.iy = a.iy + a.dy),
    {name}(id, comp) using key (id) as (
      select id, id from {nodes}
      union
      select e.b, min(p.comp) from {name} p join {name}_e e on e.a = p.id join recurring.{name} c on c.id = e.b
      where p.comp < c.comp group by e.b)"""


MASK_SQL = """mask as materialized (select cx*1000000 + cy as id, cx as ix, cy as iy, 0 as scope from cells where value > 1 and value <= 8)"""
STRIP_SQL = MASK_SQL + ", " + components_sql("strip", "mask") + """,
  shape as (select s.comp, count(*)*0.25e0 as area_m2, 0.5e0*sum(4 - coalesce(k, 0)) as perimeter_m
    from strip s left join (select a, count(*) as k from strip_e group by 1) e on e.a = s.id group by 1)"""
HEDGE_SQL = STRIP_SQL + """,
  net as materialized (select m.* from mask m join strip s using (id) join shape h using (comp) where area_m2 >= 60 and area_m2/perimeter_m <= 4),
  corner as (select min(ix) as x0, min(iy) as y0 from net),
  grid as materialized (select id, ix, iy, floor((ix - x0)/40e0)*100000 + floor((iy - y0)/40e0) as scope from net, corner), """ + \
    components_sql("piece", "grid") + """,
  areas as (select scope, comp, count(*)*0.25e0 as area_m2, row_number() over (order by scope, comp) as hedge_id
    from piece p join grid g using (id) group by 1, 2 having count(*)*0.25e0 >= 30)"""


@register("chm", "ix:i iy:i height:4",
          "select floor(x/0.5e0) as ix, floor(y/0.5e0) as iy, max(hag) as height from als group by 1, 2", "als")
def _(src):
    return structure.canopy_height(src("als"))


@register("strip_shapes", "comp_x:i comp_y:i area_m2:4 perimeter_m:4 half_width_m:6",
          f"with recursive {STRIP_SQL} select comp // 1000000 as comp_x, comp % 1000000 as comp_y, area_m2, perimeter_m, area_m2/perimeter_m as half_width_m from shape",
          "cells")
def _(src):
    chm = _chm(src)
    mask = chm.where("height > 1 and height <= 8").select("tile_id", "ix", "iy")
    return structure.strip_shapes(connected_components(mask, 4))


@register("network_stats", "n_parts:i area_m2:4 strip_width_m:6",
          f"""with recursive {STRIP_SQL} select count(*) as n_parts, sum(area_m2) as area_m2, 2*median(area_m2/perimeter_m) as strip_width_m
              from shape where area_m2 >= 60 and area_m2/perimeter_m <= 4""", "cells")
def _(src):
    mask = _chm(src).where("height > 1 and height <= 8").select("tile_id", "ix", "iy")
    return structure.network_stats(structure.strip_shapes(connected_components(mask, 4)))


@register("hedge_segments", "ix:i iy:i hedge_id:i area_m2:4",
          f"""with recursive {HEDGE_SQL} select g.ix, g.iy, a.hedge_id, a.area_m2 from piece p join grid g using (id)
              join areas a on a.scope = g.scope and a.comp = p.comp""", "cells")
def _(src):
    return structure.hedge_segments(_chm(src))


@register("point_segment", "point_idx:i seg_id:i",
          """with seg as (select cx, cy, cx // 8 + cy // 10 + 1 as hedge_id from cells where value is not null)
             select point_idx, least(coalesce(hedge_id, 0), 65535) as seg_id from als
             left join seg on seg.cx = floor(x/0.5e0) and seg.cy = floor(y/0.5e0)""", "als cells")
def _(src):
    return structure.point_segments(src("als"), _segment_cells(src))


def _segment_cells(src):
    return src("cells").where("value is not null").select(
        F.lit("a0").alias("tile_id"), F.col("cx").alias("ix"), F.col("cy").alias("iy"),
        (F.floor(F.col("cx") / 8.0) + F.floor(F.col("cy") / 10.0) + 1).alias("hedge_id"))


METRICS_SQL = """pts as (select *, cast(floor(x/12e0) + 10*floor(y/12e0) + 1 as bigint) as seg_id from als where hag >= 0),
  lay as (select seg_id, floor(hag/0.5e0) as layer, count(*) as n from pts group by 1, 2),
  ent as (select seg_id, -sum(pr*ln(pr)) as fhd, count(*) as n_layers, max(layer) as top from
    (select seg_id, layer, n/sum(n) over (partition by seg_id) as pr from lay) group by 1),
  hts as (select seg_id, quantile_cont(hag, 0.95e0) as h_p95, max(hag) as h_max, avg(case when hag < 0.5e0 then 1e0 else 0e0 end) as understory_openness from pts group by 1),
  crw as (select seg_id, coalesce(stddev_samp(h), 0) as canopy_sd, avg(case when h > 1 then 1e0 else 0e0 end) as cover_frac from
    (select seg_id, floor(x/0.5e0) as ix, floor(y/0.5e0) as iy, max(hag) as h from pts group by 1, 2, 3) group by 1),
  met as (select seg_id, fhd, coalesce(fhd/nullif(ln(top + 1), 0), 0) as vci, n_layers, coalesce(fhd/nullif(ln(n_layers), 0), 0) as strata_evenness,
    h_p95, h_max, cover_frac, canopy_sd, understory_openness, 1 - n_layers/(top + 1) as vertical_gap from ent join hts using (seg_id) join crw using (seg_id))"""


def _metrics(src):
    seg = (F.floor(F.col("x") / 12.0) + 10 * F.floor(F.col("y") / 12.0) + 1).cast("bigint")
    return structure.segment_structure(src("als").withColumn("seg_id", seg))


@register("segment_structure", "seg_id:i fhd:6 vci:6 n_layers:i strata_evenness:6 h_p95:5 h_max:4 cover_frac:6 canopy_sd:6 understory_openness:6 vertical_gap:6",
          f"with {METRICS_SQL} select * from met", "als")
def _(src):
    return _metrics(src)


_METRIC_NAMES = ["fhd", "vci", "n_layers", "strata_evenness", "h_p95", "cover_frac", "canopy_sd", "understory_openness", "vertical_gap"]
_ENDS = ", ".join(f"quantile_cont({m}, 0.02e0) as lo_{m}, quantile_cont({m}, 0.98e0) as hi_{m}" for m in _METRIC_NAMES)
_SCALED = ", ".join(f"case when hi_{m} > lo_{m} then least(greatest(({m} - lo_{m})/(hi_{m} - lo_{m}), 0), 1) else 0.5e0 end as s_{m}" for m in _METRIC_NAMES)
INDEX_SQL = METRICS_SQL + f""", ends as (select {_ENDS} from met), sc as (select seg_id, {_SCALED} from met, ends),
  idx as (select seg_id, (s_fhd + s_vci + s_n_layers + s_strata_evenness)/4 as vertical_complexity, (s_h_p95 + s_cover_frac)/2 as volume_size,
    (s_canopy_sd + s_understory_openness + 1 - s_vertical_gap)/3 as heterogeneity from sc),
  hvi as (select *, (0.5e0*vertical_complexity + 0.15e0*volume_size + 0.25e0*heterogeneity)/0.9e0 as hvi from idx)"""


@register("composite_index", "seg_id:i vertical_complexity:6 volume_size:6 heterogeneity:6 hvi:6", f"with {INDEX_SQL} select * from hvi", "als")
def _(src):
    return structure.composite_index(_metrics(src))


NDVI_SQL = """ndvi as (select cx, cy, value/12e0 - 0.2e0 as v from cells where value is not null),
  zone as (select distinct cast(floor(x/12e0) + 10*floor(y/12e0) + 1 as bigint) as seg_id, floor(x/0.5e0)*0.5e0 as zx, floor(y/0.5e0)*0.5e0 as zy from als where hag >= 0),
  zx as (select *, unnest(range(cast(floor((zx + 0.35e0)/1.3e0) as bigint), cast(floor((zx + 0.85e0)/1.3e0) as bigint) + 1)) as cx from zone),
  zxy as (select *, unnest(range(cast(floor((zy + 0.2e0)/1.3e0) as bigint), cast(floor((zy + 0.7e0)/1.3e0) as bigint) + 1)) as cy from zx),
  share as (select seg_id, cx, cy, (least(zx + 0.5e0, (cx + 1)*1.3e0 - 0.35e0) - greatest(zx, cx*1.3e0 - 0.35e0))
    *(least(zy + 0.5e0, (cy + 1)*1.3e0 - 0.2e0) - greatest(zy, cy*1.3e0 - 0.2e0)) as w from zxy),
  zonal as (select seg_id, sum(w*v)/sum(w) filter (where v is not null) as ndvi, coalesce(sum(w) filter (where v is not null), 0)/(select count(*)*0.25e0 from zone z where z.seg_id = s.seg_id) as covered
    from share s left join ndvi using (cx, cy) group by 1)"""


def _ndvi(src):
    """A raster with cells of 1.3 m that begin at (-0.35, -0.2), over the segments' cells of 0.5 m."""
    raster = src("cells").select(F.lit("a0").alias("tile_id"), F.col("cx").alias("ix"), F.col("cy").alias("iy"), (F.col("value") / 12.0 - 0.2).alias("value"))
    seg = (F.floor(F.col("x") / 12.0) + 10 * F.floor(F.col("y") / 12.0) + 1).cast("bigint")
    zone = src("als").where("hag >= 0").select("tile_id", F.floor(F.col("x") / 0.5).alias("ix"), F.floor(F.col("y") / 0.5).alias("iy"), seg.alias("seg_id")).distinct()
    return structure.zonal_mean(zone, raster, "ndvi", 0.5, 1.3, (-0.35, -0.2))


@register("segment_ndvi", "seg_id:i ndvi:8 covered:6", f"with {NDVI_SQL} select seg_id, ndvi, covered from zonal", "als cells")
def _(src):
    return _ndvi(src)


def _metrics_with_ndvi(src):
    return structure.with_zonal(_metrics(src), _ndvi(src), "ndvi")


def _values_sql() -> str:
    rows = []
    for sp, m, curve, p1, p2, p3, p4, w in dims.SPECIES_REQUIREMENTS:
        nums = ", ".join("cast(null as double)" if v is None else f"{v}e0" for v in (p1, p2, p3, p4, w))
        rows.append(f"('{sp}', '{m}', '{curve}', {nums})")
    return ", ".join(rows)


_SUIT_METRICS = ("fhd", "h_p95", "h_max", "cover_frac", "canopy_sd", "understory_openness", "vertical_gap")


def _suit_ctes(table: str, names: tuple[str, ...]) -> str:
    return f"""req as (select * from (values {_values_sql()}) as t(species, metric, curve, p1, p2, p3, p4, weight)),
  long as (unpivot (select seg_id, {', '.join(names)} from {table}) on {', '.join(names)} into name metric value value),
  mem as (select seg_id, species, weight as w, case curve when 'rising' then least(greatest((value-p1)/(p2-p1), 0), 1)
      when 'falling' then 1 - least(greatest((value-p1)/(p2-p1), 0), 1)
      else least(least(greatest((value-p1)/(p2-p1), 0), 1), least(greatest((p4-value)/(p4-p3), 0), 1)) end as m
    from long join req using (metric)),
  suit as (select seg_id, species, exp(sum(w*ln(greatest(m, 1e-6)))/sum(w)) as strict, sum(w*m)/sum(w) as tolerant from mem group by 1, 2)"""


SUIT_SQL = METRICS_SQL + ", " + _suit_ctes("met", _SUIT_METRICS)


def _suit(src):
    m = _metrics(src)
    return structure.suitability(m, dims.species_requirements(m.sparkSession))


_PLAIN_ENDS = "quantile_cont(ndvi, 0.02e0) as lo_ndvi, quantile_cont(ndvi, 0.98e0) as hi_ndvi"


@register("index_with_condition", "seg_id:i condition:6 hvi:6",
          f"""with {INDEX_SQL}, {NDVI_SQL}, ne as (select {_PLAIN_ENDS} from met left join zonal using (seg_id)),
              c as (select idx.*, case when ndvi is not null then case when hi_ndvi > lo_ndvi then least(greatest((ndvi - lo_ndvi)/(hi_ndvi - lo_ndvi), 0), 1) else 0.5e0 end end as condition
                from idx left join zonal using (seg_id) cross join ne)
              select seg_id, condition, (0.5e0*vertical_complexity + 0.15e0*volume_size + 0.25e0*heterogeneity + coalesce(0.1e0*condition, 0))
                /(0.9e0 + case when condition is null then 0 else 0.1e0 end) as hvi from c""", "als cells")
def _(src):
    return structure.composite_index(_metrics_with_ndvi(src))


_WITH_NDVI = f", {NDVI_SQL}, met2 as (select met.*, ndvi from met left join zonal using (seg_id))"


@register("suitability_with_ndvi", "seg_id:i species strict:6 tolerant:6",
          f"with {METRICS_SQL}{_WITH_NDVI}, {_suit_ctes('met2', ('ndvi', *_SUIT_METRICS))} select * from suit", "als cells")
def _(src):
    m = _metrics_with_ndvi(src)
    return structure.suitability(m, dims.species_requirements(m.sparkSession))


@register("fuzzy_membership", "seg_id:i species metric membership:6",
          f"""with {SUIT_SQL.replace('mem as (select seg_id, species, weight as w', 'mem as (select seg_id, species, metric, weight as w')}
              select seg_id, species, metric, m as membership from mem""", "als")
def _(src):
    m = _metrics(src)
    names = ["fhd", "h_p95", "h_max", "cover_frac", "canopy_sd", "understory_openness", "vertical_gap"]
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    long = m.selectExpr("seg_id", f"stack({len(names)}, {pairs}) as (metric, value)")
    rows = long.join(F.broadcast(dims.species_requirements(m.sparkSession)), "metric")
    member = structure.fuzzy_membership(F.col("value"), F.col("curve"), *[F.col(p) for p in ("p1", "p2", "p3", "p4")])
    return rows.select("seg_id", "species", "metric", member.alias("membership"))


@register("suitability", "seg_id:i species strict:6 tolerant:6", f"with {SUIT_SQL} select * from suit", "als")
def _(src):
    return _suit(src)


@register("best_species", "seg_id:i species strict:6",
          f"""with {SUIT_SQL} select seg_id, species, strict from (select *, row_number() over (partition by seg_id order by round(strict, 9) desc, species) as rn from suit)
              where rn = 1""", "als")
def _(src):
    return structure.best_species(_suit(src).withColumn("strict", F.round("strict", 9)))


@register("coloring_options", "option chunk:i n_values:i lo:6 hi:6 first_value:6",
          f"""with {SUIT_SQL}, o as (select species as option, seg_id, round(strict, 6) as v from suit)
              select option, seg_id // 20 as chunk, count(*) as n_values, min(v) as lo, max(v) as hi, arg_min(v, cast(seg_id as varchar)) as first_value from o group by 1, 2""", "als")
def _(src):
    values = _suit(src).select(F.col("species").alias("option"), "seg_id", F.round("strict", 6).alias("value"))
    maps = structure.colouring_options(values, chunk=20)
    return maps.select("option", "chunk", F.size("values").alias("n_values"), "lo", "hi",
                       F.element_at(F.map_values("values"), 1).alias("first_value"))


@register("recolor_segments", "point_idx:i r:3 g:3 b:3",
          f"""with v as (select l_suppkey % 40 + 1 as seg_id, avg(l_quantity) as value from lineitem where l_suppkey % 40 + 1 <= 30 group by 1),
              e as (select min(value) as lo, max(value) as hi from v),
              j as (select p.point_idx, p.r, p.g, p.b, p.label % 40 as seg, v.value, least(greatest((v.value - lo)/greatest(hi - lo, 1e-6), 0), 1)*5 as pos
                from points p cross join e left join v on v.seg_id = p.label % 40),
              k as (select *, least(floor(pos), 4) as lw from j),
              st as (select * from (values {", ".join(f"({i}, {s[0]}e0, {s[1]}e0, {s[2]}e0)" for i, s in enumerate(dims.RAMPS["hvi"]))}) as t(i, sr, sg, sb))
              select point_idx, case when value is not null and seg > 0 then a.sr + (z.sr - a.sr)*(pos - lw) else r end as r,
                case when value is not null and seg > 0 then a.sg + (z.sg - a.sg)*(pos - lw) else g end as g,
                case when value is not null and seg > 0 then a.sb + (z.sb - a.sb)*(pos - lw) else b end as b
              from k left join st a on a.i = lw left join st z on z.i = lw + 1""", "points")
def _(src):
    pts = src("points").withColumn("seg_id", F.col("label") % 40)
    return colours.recolour_segments(pts, _segment_values(src))


def _segment_values(src):
    cyl = src("cylinders")  # the same lineitem rows: start_z is quantity / 20
    return cyl.select((F.col("tree_id") % 40 + 1).alias("seg_id"), F.rint(F.col("start_z") * 20).alias("q")).where("seg_id <= 30").groupBy(
        "seg_id").agg(F.avg("q").alias("value"))


@register("color_ramp", "cx:i cy:i r:8 g:8 b:8",
          f"""with t as (select cx, cy, least(greatest((value - 0.5e0)/9, 0), 1)*5 as pos from cells where value is not null),
              k as (select *, least(floor(pos), 4) as lw from t),
              st as (select * from (values {", ".join(f"({i}, {s[0]}e0, {s[1]}e0, {s[2]}e0)" for i, s in enumerate(dims.RAMPS["suit"]))}) as t(i, sr, sg, sb))
              select cx, cy, a.sr + (z.sr - a.sr)*(pos - lw) as r, a.sg + (z.sg - a.sg)*(pos - lw) as g, a.sb + (z.sb - a.sb)*(pos - lw) as b
              from k join st a on a.i = lw join st z on z.i = lw + 1""", "cells")
def _(src):
    rgb = colour.ramp((F.col("value") - 0.5) / 9.0, dims.RAMPS["suit"])
    return src("cells").where("value is not null").select("cx", "cy", *[c.alias(n) for c, n in zip(rgb, "rgb")])


@register("color_by_height", "point_idx:i cr:3 cg:3 cb:3",
          f"""with e as (select quantile_cont(z, 0.02e0) as lo, quantile_cont(z, 0.98e0) as hi from points),
              k as (select point_idx, least(greatest((z - lo)/case when hi > lo then hi - lo else 1 end, 0), 1)*4 as pos from points, e),
              l as (select *, least(floor(pos), 3) as lw from k),
              st as (select * from (values {", ".join(f"({i}, {s[0]}e0, {s[1]}e0, {s[2]}e0)" for i, s in enumerate(dims.RAMPS["height"]))}) as t(i, sr, sg, sb))
              select point_idx, a.sr + (z.sr - a.sr)*(pos - lw) as cr, a.sg + (z.sg - a.sg)*(pos - lw) as cg, a.sb + (z.sb - a.sb)*(pos - lw) as cb
              from l join st a on a.i = lw join st z on z.i = lw + 1""", "points")
def _(src):
    return colours.colour_by_height(src("points"))


@register("palette_colors", "tree_id:i cr:i cg:i cb:i",
          f"""with p as (select * from (values {", ".join(f"({i}, {c[0]}, {c[1]}, {c[2]})" for i, c in enumerate(dims.PALETTE))}) as t(i, cr, cg, cb))
              select tree_id, coalesce(cr, 110) as cr, coalesce(cg, 114) as cg, coalesce(cb, 120) as cb
              from (select tree_id, case when height_m is not null then tree_id % 12 end as k from trees) left join p on p.i = k""", "trees")
def _(src):
    t = src("trees").select("tree_id", F.when(F.col("height_m").isNotNull(), F.col("tree_id")).alias("label"))
    return colours.colour_by_label(t)


@register("lad_profile", "block:i height_m:2 lad:6",
          """with v as (select floor(x/60e0) as block, floor((hag - 2)/1e0) as layer from als where hag > 0 and hag < 60),
             c as (select block, layer, count(*) as n from v group by 1, 2),
             e as (select block, unnest(range(cast(min(layer) as bigint), cast(max(layer) as bigint) + 1)) as layer from c group by 1),
             f as (select e.block, e.layer, coalesce(c.n, 0) as n from e left join c on c.block = e.block and c.layer = e.layer),
             t as (select *, sum(n) over (partition by block order by layer) as thr from f)
             select block, layer + 2.5e0 as height_m, -ln((thr - n)/thr)/0.5e0 as lad from t where layer >= 0 and thr - n > 0""", "als")
def _(src):
    return px.lad_profile(src("als").withColumn("block", F.floor(F.col("x") / 60.0)), ["block"])


@register("structural_lai", "block:i lai:6 n_layers:i height_p95_m:5",
          """with v as (select floor(x/60e0) as block, hag, floor((hag - 2)/1e0) as layer from als where hag > 0 and hag < 60),
             c as (select block, layer, count(*) as n from v group by 1, 2),
             t as (select *, sum(n) over (partition by block order by layer) as thr from c),
             l as (select block, sum(-ln((thr - n)/thr)/0.5e0) as lai, max(layer) + 1 as n_layers from t where layer >= 0 and thr - n > 0 group by 1)
             select l.*, h.height_p95_m from l join (select block, quantile_cont(hag, 0.95e0) as height_p95_m from v group by 1) h using (block)""", "als")
def _(src):
    return px.structural_lai(src("als").withColumn("block", F.floor(F.col("x") / 60.0)), ["block"])


@register("relief", "cx:i cy:i elevation_m:7 slope_deg:5 aspect_ref_deg:4 aspect_compass_deg:4",
          """with n as (select c.cx, c.cy, c.value as here, (e.value - w.value)/60 as dzdx, (n.value - s.value)/60 as dzdy from cells c
               join cells n on n.cx = c.cx and n.cy = c.cy + 1 join cells s on s.cx = c.cx and s.cy = c.cy - 1
               join cells e on e.cx = c.cx + 1 and e.cy = c.cy join cells w on w.cx = c.cx - 1 and w.cy = c.cy
               where c.value is not null and n.value is not null and s.value is not null and e.value is not null and w.value is not null),
             g as (select *, degrees(atan(sqrt(dzdx*dzdx + dzdy*dzdy))) as slope_deg from n)
             select cx, cy, here as elevation_m, slope_deg, case when slope_deg >= 0.1e0 then (degrees(atan2(dzdy, -dzdx)) + 360) % 360 end as aspect_ref_deg,
               case when slope_deg >= 0.1e0 then (degrees(atan2(-dzdx, -dzdy)) + 360) % 360 end as aspect_compass_deg from g""", "cells")
def _(src):
    return prov.relief(src("cells"))


@register("raster_sample", "det_id:i value:5 error",
          """with c as (select cy as row, cx as col, value from cells),
             k as (select det_id, floor((x - 2)/0.1e0) as col, floor((18 - y)/0.1e0) as row from detections)
             select k.det_id, case when k.col between 0 and 119 and k.row between 0 and 119 then c.value end as value,
               case when k.col between 0 and 119 and k.row between 0 and 119 then null else 'outside raster' end as error
             from k left join c on c.row = k.row and c.col = k.col""", "cells detections")
def _(src):
    cells = src("cells").select(F.col("cy").alias("row"), F.col("cx").alias("col"), "value")
    return prov.raster_sample(src("detections"), cells, 0.1, 2.0, 18.0, 120, 120)


@register("tile_plan", "stand_id:i tile_x:i tile_y:i width:i height:i tile_xmin:3 tile_ymin:3 tile_xmax:3 tile_ymax:3",
          """with e as (select stand_id, min(x) as xmin, min(y) as ymin, max(x) + 1 as xmax, max(y) + 1 as ymax from trees group by 1),
             s as (select *, cast(round((xmax - xmin)/0.01e0) as int) as w, cast(round((ymax - ymin)/0.01e0) as int) as h from e),
             t as (select *, unnest(range(0, (w + 1999) // 2000)) as tile_x from s),
             u as (select *, unnest(range(0, (h + 1999) // 2000)) as tile_y from t)
             select stand_id, tile_x, tile_y, least((tile_x + 1)*2000, w) - tile_x*2000 as width, least((tile_y + 1)*2000, h) - tile_y*2000 as height,
               xmin + tile_x*2000*0.01e0 as tile_xmin, ymax - least((tile_y + 1)*2000, h)*0.01e0 as tile_ymin,
               xmin + least((tile_x + 1)*2000, w)*0.01e0 as tile_xmax, ymax - tile_y*2000*0.01e0 as tile_ymax from u""", "trees")
def _(src):
    ext = src("trees").groupBy("stand_id").agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), (F.max("x") + 1).alias("xmax"), (F.max("y") + 1).alias("ymax"))
    return prov.tile_plan(ext, 0.01)


@register("osm_context", "place_id:i landuse leaf_type name protected_area",
          """with el as (select det_id as pos, x as ex, y as ey, case when n_points % 3 = 0 then 'forest' when n_points % 3 = 1 then 'meadow' end as landuse,
               case when n_points % 3 = 2 and n_points % 2 = 0 then 'wood' end as nat, case when n_points % 7 = 0 then 'protected_area' end as boundary,
               case when n_points % 2 = 0 then 'broadleaved' else 'needleleaved' end as leaf, concat('E', cast(n_points as varchar)) as nm from detections),
             near as (select ref_id, el.* from refs join el on sqrt((ex-ref_x)*(ex-ref_x) + (ey-ref_y)*(ey-ref_y)) <= 1.5e0),
             f as (select ref_id, arg_min({'l': coalesce(landuse, case when nat is not null then 'wood' end), 'f': leaf, 'n': nm}, pos) as f from near
               where boundary is null and (landuse = 'forest' or nat = 'wood') group by 1),
             p as (select ref_id, arg_min(nm, pos) as a from near where boundary is not null group by 1)
             select r.ref_id as place_id, f.f.l as landuse, f.f.f as leaf_type, f.f.n as name, p.a as protected_area
             from refs r left join f using (ref_id) left join p using (ref_id)""", "refs detections")
def _(src):
    return prov.map_context(_context_places(src), _context_elements(src), 1.5)


def _context_places(src):
    return src("refs").select(F.col("ref_id").alias("place_id"), F.col("ref_x").alias("x"), F.col("ref_y").alias("y"))


def _context_elements(src):
    n = F.col("n_points")
    tags = F.map_filter(F.create_map(
        F.lit("landuse"), F.when(n % 3 == 0, "forest").when(n % 3 == 1, "meadow"),
        F.lit("natural"), F.when((n % 3 == 2) & (n % 2 == 0), "wood"), F.lit("boundary"), F.when(n % 7 == 0, "protected_area"),
        F.lit("leaf_type"), F.when(n % 2 == 0, "broadleaved").otherwise("needleleaved"), F.lit("name"), F.concat(F.lit("E"), n.cast("string"))),
        lambda k, v: v.isNotNull())
    return src("detections").select(F.col("det_id").alias("pos"), F.col("x").alias("ex"), F.col("y").alias("ey"), tags.alias("tags"))


@register("provenance_record", "place_id:i lat:4 provider relief_error slope_deg:4 osm_error landuse",
          """with pl as (select ref_id as place_id, case when ref_id % 9 = 0 then null else 40 + ref_y end as lat, case when ref_id % 2 = 0 then 'survey' end as provider from refs),
             rl as (select ref_id as place_id, ref_x*2 as slope_deg from refs where ref_id % 4 <> 0),
             om as (select ref_id as place_id, 'forest' as landuse from refs where ref_id % 5 <> 0)
             select pl.place_id, lat, provider, case when lat is not null and rl.place_id is null then 'no data' end as relief_error,
               case when lat is not null then slope_deg end as slope_deg, case when lat is not null and om.place_id is null then 'no data' end as osm_error,
               case when lat is not null then landuse end as landuse from pl left join rl using (place_id) left join om using (place_id)""", "refs")
def _(src):
    r = src("refs").withColumnRenamed("ref_id", "place_id")
    places = r.select("place_id", F.when(F.col("place_id") % 9 != 0, F.col("ref_y") + 40).alias("lat"),
                      F.when(F.col("place_id") % 9 != 0, F.col("ref_x")).alias("lon"), F.when(F.col("place_id") % 2 == 0, "survey").alias("provider"),
                      F.lit("CC-BY-4.0").alias("license"), F.lit(None).cast("string").alias("image_url"),
                      F.lit(5.0).alias("coord_precision_m"), F.lit("gps").alias("coord_source"))
    rec = prov.provenance_record(places, {
        "relief": r.where("place_id % 4 <> 0").select("place_id", (F.col("ref_x") * 2).alias("slope_deg")),
        "osm_context": r.where("place_id % 5 <> 0").select("place_id", F.lit("forest").alias("landuse"))})
    return rec.select("place_id", "geometry.lat", "source.provider", F.col("geo_enriched.relief.error").alias("relief_error"),
                      F.col("geo_enriched.relief.slope_deg").alias("slope_deg"), F.col("geo_enriched.osm_context.error").alias("osm_error"),
                      F.col("geo_enriched.osm_context.landuse").alias("landuse"))
