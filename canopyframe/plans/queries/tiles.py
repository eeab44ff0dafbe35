"""Cloud queries on two tiles that overlap: the second repeats two thirds of the first, coordinates and numbers included.

Each query must give what it gives on either tile alone, so its oracle is that of
the single tile, run on each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyframe.plans.carriers import oracle_carrier
from canopyframe.plans.catalog import REGISTRY, Entry

#: Carriers that become two tiles: the name of the first, and which rows the second repeats.
CLOUDS = {"points": ("t0", "point_idx % 3 > 0"), "als": ("a0", "point_idx % 3 > 0"), "cells": ("c0", "(cx + 2*cy) % 5 > 0")}
#: Queries whose rows name their tile.
KEYS = ("ground_model", "normalize_height", "normalize_height_default", "height_band", "stem_clusters", "stem_inventory", "nearest_stem", "plot_summary",
        "rasterize_view", "chm", "segment_structure", "suitability", "best_species", "recolor_segments", "voxel_thin",
        "strip_shapes", "hedge_segments")


def two_tiles(cloud: DataFrame, tile: str, part: str) -> DataFrame:
    cloud = cloud.withColumn("tile_id", F.lit(tile))
    return cloud.unionByName(cloud.where(part).withColumn("tile_id", F.concat("tile_id", F.lit("-again"))))


def _oracle(entry: Entry) -> str:
    names = ", ".join(item.partition(":")[0] for item in entry.columns.split() if item != "tile_id")

    def on(again: bool) -> str:
        ctes = ", ".join(f"{c} as (select * from ({oracle_carrier(c)}) as whole{f' where {CLOUDS[c][1]}' if again and c in CLOUDS else ''})" for c in entry.carriers)
        body = entry.oracle.strip()
        for head in ("with recursive ", "with "):
            if body.lower().startswith(head):
                return f"{head}{ctes}, {body[len(head):]}"
        return f"with {ctes} {body}"

    first = next(CLOUDS[c][0] for c in entry.carriers if c in CLOUDS)
    return " union all ".join(f"select '{first}{suffix}' as tile_id, {names} from ({on(bool(suffix))}) as t" for suffix in ("", "-again"))


def _register(key: str) -> None:
    entry = REGISTRY[key]

    def build(src):
        return entry.build(lambda name: two_tiles(src(name), *CLOUDS[name]) if name in CLOUDS else src(name))

    columns = entry.columns if "tile_id" in entry.columns.split() else f"tile_id {entry.columns}"
    REGISTRY[f"{key}_two_tiles"] = Entry(build, columns, _oracle(entry), ())


for _key in KEYS:
    _register(_key)
