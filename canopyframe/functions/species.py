"""Species names from short codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopyframe.dims import CATEGORY_SPECIES, SPECIES_ABBREVIATIONS


def _lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    pairs = [F.lit(v) for item in table.items() for v in item]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)


def species_of_tree_key(key: Column) -> Column:
    """Common name from a tree key such as ``QuePet_BR01_01``; unknown abbreviations are kept."""
    short = F.substring_index(key, "_", 1)
    return _lookup(short, SPECIES_ABBREVIATIONS, short)


def species_of_category(category: Column) -> Column:
    """Species of an annotation category, null for categories that are not trees."""
    return _lookup(category, CATEGORY_SPECIES)
