"""Class dictionary, model weights, table schemas and default parameters.

Everything in this module is a fixed value or derived from one. Probability tables are kept *wide*: one
``ARRAY<DOUBLE>`` column per category, elements in class-code order, NULL when the category has no value.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: classes, in class-code order (code = position) -------------------------------------
CLASSES: dict[str, tuple[str, ...]] = {
    "dominant_cover": ("blurry", "vegetation", "residue", "soil", "snow", "water"),
    "crop_type": ("blurry", "unknown_plant", "corn", "wheat/barley", "soybean", "alfalfa", "other", "no_crop"),
    "crop_status": ("blurry", "emergence", "growth", "flowers", "senescing", "senesced", "no_crop"),
}

# ---- fixed values: order of classes in reports, bottom of the chart first -----------------------------
DISPLAY_ORDER = (
    "blurry", "no_crop", "water", "snow", "residue", "soil", "vegetation",
    "unknown_plant", "other", "alfalfa", "soybean", "wheat/barley", "corn",
    "senesced", "senescing", "flowers", "growth", "emergence",
    "overall",
)

# ---- fixed values: transition weights of the two hidden Markov models (rows: from, columns: to) -------
COVER_STATES = ("vegetation", "residue", "soil", "snow", "water")
COVER_WEIGHTS = (
    (95.0, 1.25, 1.25, 1.25, 1.25),
    (1.25, 95.0, 1.25, 1.25, 1.25),
    (5 / 3, 0.0, 95.0, 5 / 3, 5 / 3),
    (1.25, 1.25, 1.25, 95.0, 1.25),
    (1.25, 1.25, 1.25, 1.25, 95.0),
)
STATUS_STATES = ("emergence", "growth", "flowers", "senescing", "senesced", "no_crop")
STATUS_WEIGHTS = (
    (90.0, 5.0, 0.0, 0.0, 0.0, 5.0),
    (0.0, 90.0, 2.5, 2.5, 0.0, 5.0),
    (0.0, 0.0, 90.0, 5.0, 0.0, 5.0),
    (0.0, 1.0, 0.0, 90.0, 4.5, 4.5),
    (0.0, 1.0, 0.0, 0.0, 90.0, 9.0),
    (10.0, 0.0, 0.0, 0.0, 0.0, 90.0),
)

# ---- fixed values: state changes that name a transition -----------------------------------------------
TRANSITION_SIGNATURES = (
    ("dominant_cover", "vegetation", "soil", "harvest-to-soil"),
    ("dominant_cover", "vegetation", "residue", "harvest-to-residue"),
    ("dominant_cover", "residue", "soil", "tillage"),
    ("crop_status", "no_crop", "emergence", "emergence"),
)

# ---- fixed values: season of a greenness transition (direction, threshold) ----------------------------
SEASON_PERIODS = (
    ("falling", "transition_50", "senescing"),
    ("falling", "transition_25", "senescing"),
    ("falling", "transition_10", "senesced"),
    ("rising", "transition_50", "peak"),
    ("rising", "transition_25", "growing"),
    ("rising", "transition_10", "growing"),
)

# ---- fixed values: cameras left out of the site list (pastures, experimental plots, others) -----------
PASTURE_SITES = (
    "uiefprairie2", "archboldavir", "archboldavirx", "archboldbahia", "archboldpnot", "archboldpnotx",
    "tworfpr", "harvardfarmnorth", "harvardfarmsouth", "harvardgarden", "rosemountnprs", "sweetbriargrass",
    "kelloggrestoredprairie", "meadpasture", "meadpasturesw", "meadpasturese", "NEON.D04.LAJA.DP1.00033",
    "wolfesneckfarm",
)
EXPERIMENTAL_SITES = (
    "arsmnswanlake1", "kelloggcorn2", "kelloggcorn3", "kelloggmiscanthus", "kelloggoldfield", "kingmanfarm",
    "NEON.D10.STER", "silverton", "tworfta",
)
OTHER_EXCLUDED_SITES = ("turkeypointenf02", "armoklahoma", "tidmarshplymouth")
EXCLUDED_SITES = PASTURE_SITES + EXPERIMENTAL_SITES + OTHER_EXCLUDED_SITES

# ---- fixed values: default parameters -----------------------------------------------------------------
SNOW_GAP_ROWS = 60            # longest gap bridged after the snow mask
BLUR_GAP_DAYS = 3             # longest gap bridged on the filled calendar
PROFILE_GAP_ROWS = 5          # longest gap bridged by the simple profile
MIN_SEQUENCE_DAYS = 60        # a sequence must be longer than this
UNKNOWN_CROP_MAX_DAYS = 60    # emergence-dominated segments up to this length have no known crop
IMAGES_PER_PERIOD = 50
EXTRA_HOURS = (9, 10, 11, 12, 13, 14, 15)
MIN_COMBO_IMAGES = 40
VALIDATION_FRACTION = 0.2
VALIDATION_SITES = r"(arsmorris2)|(mandani2)|(cafboydnorthltar01)"
RESAMPLE_SIZE = 100_000
SCORE_BATCH = 500
SCORE_DIGITS = 4
HARVEST_WINDOW = 7
HARVEST_VEGETATION = -0.2
HARVEST_SOIL_RESIDUE = 0.2
SITE_YEAR_MIN_DAYS = 250

# ---- derived -----------------------------------------------------------------------------------------
CATEGORIES = tuple(CLASSES)
WIDTHS = {category: len(names) for category, names in CLASSES.items()}
HMM_MODELS = {"dominant_cover": (COVER_STATES, COVER_WEIGHTS), "crop_status": (STATUS_STATES, STATUS_WEIGHTS)}


def class_columns(category: str) -> list[str]:
    """Column names of one category in the flat exchange form, e.g. ``crop_type-corn``."""
    return [f"{category}-{name}" for name in CLASSES[category]]


def class_label(name: str) -> str:
    """Title-case display label: ``no_crop`` -> ``No Crop``, ``wheat/barley`` -> ``Wheat/Barley``."""
    return name.replace("_", " ", 1).title()


def code(category: str, name: str) -> int:
    return CLASSES[category].index(name)


# predictions as exchanged between stages: one DOUBLE column per class
PREDICTION_CSV_SCHEMA = T.StructType(
    [T.StructField("filepath", T.StringType()), T.StructField("file", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for category in CATEGORIES for c in class_columns(category)]
)
