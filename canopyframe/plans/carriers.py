"""Carrier views: the driver tables shaped like clouds, rasters, images and manifests.

One SQL text per carrier serves Spark and the DuckDB oracle. The dialects differ in
two places: ``{elt}`` is the zero-based list access, and ``{mille}`` is 1000 in the
single precision of the list (Spark takes a float times an integer as a double, which
puts a value next to a step on another level).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# order and line number repeat in the driver's lineitem; part and quantity make the row id distinct
_ROW_ID = "((l_orderkey*8 + l_linenumber)*1000000 + l_partkey)*64 + cast(l_quantity as bigint)"
_STEM_R = "(0.06e0 + 0.02e0*(l_suppkey % 12))"
_STEM_X = "(4.0e0*(l_suppkey % 32) + 0.125e0)"
_STEM_Y = "(4.0e0*floor(l_suppkey/32.0e0) + 0.125e0)"
_ANGLE = "radians(cast((l_orderkey*7 + l_partkey*13) % 360 as double))"

CARRIERS = {
    "points": f"""
        select 't0' as tile_id, {_ROW_ID} as point_idx, l_suppkey + 1 as label,
          case when l_linenumber >= 6 then 2 when l_linenumber = 5 then 1 else 0 end as class,
          round(case when l_linenumber >= 6 then {_STEM_X} + ((l_partkey*37) % 100 - 50)/100.0e0
                else {_STEM_X} + {_STEM_R}*cos({_ANGLE}) end, 4) + 0.0e0 as x,
          round(case when l_linenumber >= 6 then {_STEM_Y} + ((l_orderkey*53) % 100 - 50)/100.0e0
                else {_STEM_Y} + {_STEM_R}*sin({_ANGLE}) end, 4) + 0.0e0 as y,
          round(case when l_linenumber >= 6 then 0.0e0
                when l_linenumber = 5 then 2 + (10 + l_suppkey % 15)*((l_orderkey % 101)/100.0e0)
                else 0.7e0 + 1.3e0*((l_orderkey % 97)/97.0e0) end, 4) as z,
          cast((l_orderkey*31) % 256 as int) as r, cast((l_partkey*17) % 256 as int) as g,
          cast((l_suppkey*7 + l_linenumber) % 256 as int) as b
        from lineitem""",
    "cells": """
        select o_orderkey % 120 as cx, cast(floor(o_orderkey/120.0e0) as bigint) as cy,
          case when o_orderpriority = '5-LOW' then null else o_totalprice/50000.0e0 end as value
        from orders""",
    "pixels": """
        select vec_id as image_id, cast(floor(i/8.0e0) as int) as row, cast(i % 8 as int) as col,
          cast(floor(abs({elt})*{mille}) as int) % 256 as r,
          cast(floor(abs({elt7})*{mille}) as int) % 256 as g,
          cast(floor(abs({elt13})*{mille}) as int) % 256 as b
        from embeddings cross join range(64) as t(i)""",
    "image_labels": """
        select vec_id as image_id, label % 3 as class_no from embeddings""",
    "trees": """
        select c_custkey as tree_id, c_nationkey as stand_id, c_mktsegment as species_name,
          2.0e0*(c_custkey % 40) as x, 2.0e0*floor(c_custkey/40.0e0) as y,
          5 + (c_custkey % 600)/10.0e0 as dbh_cm,
          case when c_custkey % 11 = 0 then null else round(4 + (c_custkey % 270)/10.0e0, 1) end as height_m
        from customer""",
    "detections": """
        select p_partkey as det_id, round((p_partkey*37 % 1000)/50.0e0 + 0.003e0, 4) as x,
          round((p_partkey*91 % 1000)/50.0e0 + 0.007e0, 4) as y, p_size as n_points,
          (p_partkey % 31)/10.0e0 as fit_rms_cm
        from part""",
    "refs": """
        select s_suppkey as ref_id, round((s_suppkey*41 % 1000)/50.0e0 + 0.0042e0, 4) as ref_x,
          round((s_suppkey*83 % 1000)/50.0e0 + 0.0096e0, 4) as ref_y
        from supplier""",
    "measurements": """
        select o_custkey as marker_id, count(*) as n_views, avg(o_totalprice/500000.0e0) as green_share,
          max(o_totalprice) as structure
        from orders group by o_custkey""",
    "views": """
        select o_custkey as marker_id, o_orderkey as view_id, o_totalprice/500000.0e0 as green_share,
          (o_orderkey % 17)/17.0e0 as gli, o_orderstatus as verdict
        from orders""",
    "markers": f"""
        select concat('s', cast(l_orderkey as varchar(20))) as scene_id, l_linenumber as pos,
          {_ROW_ID} as marker_key,
          l_quantity as dbh_cm, case when l_returnflag = 'N' then null else l_tax*100 end as height_m,
          l_extendedprice/1000.0e0 as dx, l_discount*100 - 5 as dy, l_quantity/10.0e0 as dz
        from lineitem""",
    "scenes": """
        select o_orderkey as scene_key, concat('s', cast(o_orderkey as varchar(20))) as id,
          concat('Scene ', o_orderpriority) as title,
          case when o_orderkey % 7 = 0 then null else o_orderdate end as created,
          case o_orderstatus when 'F' then 'e57' when 'O' then 'insta360' else 'images' end as source_type,
          case when o_orderkey % 3 = 0 then null else concat('scenes/s', cast(o_orderkey as varchar(20)), '/pano.jpg') end as pano,
          case when o_orderkey % 4 = 0 then null else concat('scenes/s', cast(o_orderkey as varchar(20)), '/thumb.jpg') end as thumb,
          case when o_orderkey % 5 = 0 then concat('scenes/s', cast(o_orderkey as varchar(20)), '/walk.mp4') else null end as video,
          case when o_orderkey % 11 = 0 then 'model.ply' else null end as splat,
          case when o_orderkey % 2 = 0 then concat('scenes/s', cast(o_orderkey as varchar(20)), '/cloud.bin') else null end as cloud,
          case when o_orderkey % 13 = 0 then 'tour' else null end as kind,
          case when o_orderkey % 6 = 0 then null else 46.0e0 + (o_orderkey % 500)/100.0e0 end as gps_lat,
          case when o_orderkey % 6 = 0 then null else 6.0e0 + (o_orderkey % 900)/100.0e0 end as gps_lon,
          case when o_orderkey % 4 = 0 then null else 47.0e0 + (o_orderkey % 300)/100.0e0 end as geom_lat,
          case when o_orderkey % 4 = 0 then null else 7.0e0 + (o_orderkey % 400)/100.0e0 end as geom_lon,
          o_custkey as owner_key
        from orders""",
    "accounts": """
        select c_custkey as marker_id, c_custkey as row_idx, c_acctbal as structure from customer where c_custkey % 7 > 0""",
    "publish_list": """
        select case when c_custkey % 10 = 0 then c_custkey + 1000000000 else c_custkey end as publish_key
        from customer where c_mktsegment = 'BUILDING'""",
    "job_events": """
        select event_id, user_id as job_id, ts, value as duration_s, props as params,
          case event_type when 'signup' then 'queued' when 'view' then 'running' when 'click' then 'running'
            when 'purchase' then 'done' else 'error' end as status
        from events""",
    "cylinders": f"""
        select l_suppkey as tree_id, l_linenumber as branch_order, {_ROW_ID} as cyl_idx,
          0.01e0 + l_discount as radius, l_quantity/20.0e0 as start_z,
          l_quantity/20.0e0 + 0.05e0 + l_tax as end_z
        from lineitem""",
    "cameras": """
        select n_nationkey as camera_id, 4.0e0*n_regionkey as tx, 4.0e0*(n_nationkey % 5) as ty, 1.6e0 as tz,
          cos(radians(7.2e0*n_nationkey)) as qw, 0.0e0 as qx, 0.0e0 as qy, sin(radians(7.2e0*n_nationkey)) as qz
        from nation""",
    "splats": f"""
        select {_ROW_ID} as splat_id,
          l_quantity/10.0e0 as x, l_discount*50 as y, (l_partkey % 1000)/100.0e0 as z,
          l_tax*20 - 1 as f_dc_0, l_discount*10 - 0.5e0 as f_dc_1, (l_orderkey % 9)/9.0e0 - 0.5e0 as f_dc_2,
          ((l_orderkey*13) % 100)/20.0e0 - 2.5e0 as opacity,
          -3.0e0 + (l_partkey % 30)/10.0e0 as scale_0, -2.5e0 + (l_suppkey % 25)/12.0e0 as scale_1,
          -2.0e0 + l_linenumber/5.0e0 as scale_2
        from lineitem""",
    "als": f"""
        select 'a0' as tile_id, {_ROW_ID} as point_idx,
          round(((l_orderkey*17 + l_linenumber*5) % 4800)/40.0e0 + 0.003e0, 4) as x,
          round(((l_orderkey*29 + l_partkey*7) % 4800)/40.0e0 + 0.003e0, 4) as y,
          round(l_quantity/5.0e0 + l_discount, 4) as hag,
          case when l_returnflag = 'R' and l_linenumber = 7 then 6 when l_linenumber = 6 then 2 else 1 end as class
        from lineitem""",
}


def oracle_carrier(name: str) -> str:
    """Carrier text for DuckDB."""
    return _fill(CARRIERS[name], "embedding[{i} + 1]", "1000")


def carrier(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Carrier as a DataFrame over the parquet tables in ``sf_dir``."""
    text = _fill(CARRIERS[name], "embedding[{i}]", "cast(1000 as float)")
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"from {t}" in text}
    for t in used:
        text = text.replace(f"from {t}", "from {" + t + "}")
    df = spark.sql(text, **used)
    return _computed_once(df) if name in _HEAVY else df


#: Carriers whose columns are long expressions.
_HEAVY = ("points", "als", "pixels")


def _computed_once(df: DataFrame) -> DataFrame:
    """Keep the optimizer from repeating the carrier expressions in every operator that uses a column."""
    row = F.struct(*df.columns).alias("_row")
    return df.select(F.explode(F.array(row)).alias("_row")).select("_row.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table.

    The driver writes each table as a single row group, which Spark reads in one
    task. A table with fewer splits than cores is spread before the carrier
    expressions run; tables with enough splits are left alone.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name == "lineitem" and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df


def with_carriers(body: str, *names: str) -> str:
    """Prefix an oracle query with its carriers as common table expressions."""
    ctes = ", ".join(f"{n} as ({oracle_carrier(n)})" for n in names)
    body = body.strip()
    if body.lower().startswith("with recursive"):
        return f"with recursive {ctes}, {body[len('with recursive'):]}"
    if body.lower().startswith("with "):
        return f"with {ctes}, {body[len('with '):]}"
    return f"with {ctes} {body}"


def _fill(text: str, access: str, mille: str) -> str:
    return (text.replace("{mille}", mille).replace("{elt}", access.format(i="cast(i as int)"))
            .replace("{elt7}", access.format(i="cast((i+7) % 64 as int)"))
            .replace("{elt13}", access.format(i="cast((i+13) % 64 as int)")))
