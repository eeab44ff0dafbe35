"""Small dimension tables. All entries are fixed values required for matching results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: species name or synonym -> species code
SPECIES_CODES = {
    "eiche": 110, "quercus": 110,
    "buche": 211, "fagus": 211, "fagus sylvatica": 211,
    "birke": 421, "betula": 421,
    "fichte": 511, "picea": 511, "picea abies": 511,
    "tanne": 517, "abies": 517, "abies alba": 517,
    "douglasie": 611, "pseudotsuga": 611,
    "kiefer": 711, "pinus": 711, "pinus sylvestris": 711,
    "laerche": 811, "larix": 811,
}

# fixed values: species code -> yearly growth (diameter in cm, height in m)
GROWTH_RATES = {
    110: (0.28, 0.18), 211: (0.30, 0.20), 421: (0.35, 0.22), 511: (0.40, 0.25),
    517: (0.38, 0.24), 611: (0.55, 0.35), 711: (0.30, 0.18), 811: (0.45, 0.28),
}
# fixed values: yearly growth of every other species
DEFAULT_RATE = (0.35, 0.18)

# fixed values: species abbreviation in single-tree file names -> common name
SPECIES_ABBREVIATIONS = {
    "AcePse": "sycamore maple", "FagSyl": "European beech", "PicAbi": "Norway spruce", "PinSyl": "Scots pine",
    "PseMen": "Douglas fir", "QuePet": "sessile oak", "QueRub": "red oak",
}

# fixed values: annotation category -> species of the image training set
CATEGORY_SPECIES = {6: "spruce", 7: "birch", 8: "pine"}

# fixed values: cyclic colours for tree labels
PALETTE = ((230, 100, 90), (90, 200, 120), (95, 160, 240), (240, 190, 80), (200, 120, 230), (90, 210, 210),
           (240, 140, 60), (160, 210, 90), (240, 130, 180), (130, 140, 240), (80, 190, 160), (220, 220, 110))

# fixed values: colour of points without a tree
UNASSIGNED_RGB = (110, 114, 120)

# fixed values: colour ramps, low to high
RAMPS = {
    "hvi": ((222, 214, 176), (190, 205, 140), (140, 190, 110), (84, 165, 100), (40, 130, 95), (20, 92, 80)),
    "suit": ((70, 74, 82), (150, 140, 90), (216, 179, 60), (225, 110, 90), (190, 60, 140), (130, 40, 130)),
    "height": ((30, 45, 90), (30, 120, 110), (130, 190, 80), (235, 225, 120), (250, 250, 250)),
    "branch_order": ((150, 108, 68), (150, 130, 70), (120, 165, 80), (100, 190, 95), (150, 215, 120)),
}

# fixed values: density levels of published clouds (voxel in metres, largest point count)
CLOUD_LEVELS = {"lite": (0.10, 160_000), "full": (0.04, 700_000)}

# fixed values: classes removed before hedge extraction (building, water, other structures)
INFRASTRUCTURE_CLASSES = (6, 9, 26)

# fixed values: weights of the sub-indices of the hedge index
INDEX_WEIGHTS = {"vertical_complexity": 0.50, "volume_size": 0.15, "heterogeneity": 0.25, "condition": 0.10}

# Default response curves per target species. Uncalibrated starting values chosen for this
# package: (species, metric, curve type, p1, p2, p3, p4, weight).
SPECIES_REQUIREMENTS = (
    ("shrike", "h_p95", "trapezoid", 0.8, 1.5, 3.0, 4.5, 2.0),
    ("shrike", "understory_openness", "rising", 0.1, 0.5, None, None, 1.0),
    ("shrike", "fhd", "rising", 0.2, 1.0, None, None, 1.0),
    ("whitethroat", "h_p95", "trapezoid", 0.5, 1.0, 2.5, 4.0, 2.0),
    ("whitethroat", "cover_frac", "rising", 0.3, 0.8, None, None, 1.0),
    ("whitethroat", "canopy_sd", "rising", 0.1, 0.8, None, None, 1.0),
    ("yellowhammer", "h_max", "trapezoid", 1.5, 3.0, 6.0, 9.0, 1.5),
    ("yellowhammer", "canopy_sd", "rising", 0.2, 1.0, None, None, 1.0),
    ("yellowhammer", "understory_openness", "rising", 0.1, 0.4, None, None, 1.0),
    ("bats", "h_p95", "rising", 2.0, 6.0, None, None, 2.0),
    ("bats", "cover_frac", "rising", 0.5, 0.95, None, None, 1.5),
    ("bats", "vertical_gap", "falling", 0.1, 0.6, None, None, 1.0),
    ("wild_bees", "h_p95", "falling", 1.0, 4.0, None, None, 1.0),
    ("wild_bees", "understory_openness", "rising", 0.2, 0.7, None, None, 1.5),
    ("wild_bees", "ndvi", "trapezoid", 0.1, 0.3, 0.7, 0.9, 1.0),
)


def species_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(SPECIES_CODES.items()), "species_key string, species_code int")


def growth_rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in sorted(GROWTH_RATES.items())],
                                 "species_code int, dbh_rate double, height_rate double")


def species_requirements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SPECIES_REQUIREMENTS), "species string, metric string, curve string, "
                                 "p1 double, p2 double, p3 double, p4 double, weight double")
