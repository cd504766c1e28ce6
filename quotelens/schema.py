"""Domains, registries and tier maps of the quote data model.

The lists below are FIXED VALUES that must equal the reference's for
right results (column domains, description registry, modifier weights,
ordinal tiers, thresholds). They are stated as plain text in their
natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---- FIXED VALUES: column domains -----------------------------------------
VALID_MATERIALS = [
    "Aluminum 6061",
    "Aluminum 7075",
    "Inconel 718",
    "Stainless Steel 17-4 PH",
    "Titanium Grade 5",
]
VALID_PROCESSES = [
    "3-Axis Milling",
    "5-Axis Milling",
    "CNC Turning",
    "Surface Grinding",
    "Wire EDM",
]
VALID_ESTIMATORS = ["Sato-san", "Suzuki-san", "Tanaka-san"]
VALID_QUANTITIES = [1, 5, 10, 20, 50, 100]

# ---- FIXED VALUES: description registry (registry order = tie order) -------
BASE_PART_TYPES = [
    "Actuator Linkage",
    "Electronic Chassis",
    "Fuel Injector Nozzle",
    "Heat Sink",
    "Landing Gear Pin",
    "Manifold Block",
    "Mounting Bracket",
    "Sensor Housing",
    "Structural Rib",
    "Turbine Blade Housing",
]
# modifier text -> (flag, complexity weight)
MODIFIER_REGISTRY = [
    ("thin walls", "thin_walls", 2),
    ("complex internal channels", "complex_internal", 3),
    ("high precision", "high_precision", 2),
    ("hardened", "hardened", 1),
    ("threaded", "threaded", 1),
    ("aerospace grade", "aerospace_grade", 1),
    ("EMI shielded", "emi_shielded", 1),
    ("high fin density", "high_fin_density", 2),
    ("standard", "standard", 0),
]
COMPLEXITY_FLAGS = [flag for _text, flag, _w in MODIFIER_REGISTRY]
FUZZY_MATCH_THRESHOLD = 85.0
UNKNOWN_PART = "UNKNOWN"

# ---- FIXED VALUES: ordinal tiers (NULL / unknown -> 3.0) --------------------
MATERIAL_COST_TIER = {
    "Aluminum 6061": 1,
    "Aluminum 7075": 2,
    "Stainless Steel 17-4 PH": 3,
    "Titanium Grade 5": 4,
    "Inconel 718": 5,
}
PROCESS_PRECISION_TIER = {
    "Surface Grinding": 1,
    "CNC Turning": 2,
    "3-Axis Milling": 3,
    "Wire EDM": 4,
    "5-Axis Milling": 5,
}
DEFAULT_TIER = 3.0

# fixed category order for one-hot / label codes (alphabetical)
LABEL_CATEGORIES = {
    "base_part_type": sorted(BASE_PART_TYPES),
    "material": sorted(VALID_MATERIALS),
    "process": sorted(VALID_PROCESSES),
    "estimator": sorted(VALID_ESTIMATORS),
}

# ---- FIXED VALUES: workflow enumerations -----------------------------------
OVERRIDE_REASONS = [
    "material_hardness",
    "geometry_complexity",
    "surface_finish",
    "tooling_difficulty",
    "customer_relationship",
    "scrap_risk",
    "certification_requirements",
    "other",
]
LOSS_REASONS = ["price_too_high", "lead_time", "went_with_competitor", "scope_change", "other"]
CLOSING_OUTCOMES = ["won", "lost", "expired"]
QUOTE_STATUSES = ["draft", "review", "sent", "won", "lost", "expired"]

# ---- FIXED VALUES: model names and settings --------------------------------
N_FOLDS = 5
M0_DEFAULT_RUSH = 1.55
M0_DEFAULT_SLOPE = -0.19
MODEL_NAMES = ["M0", "M1", "M2", "M3a", "M3b", "M4", "M5", "M6", "M6b", "M7",
               "M7b", "M7c", "M8", "M9"]
TOP_TIER_LINEAR = ["M2", "M3a", "M3b", "M4"]
TOP_TIER_TREE = ["M7"]
DEBIASED_MODELS = ["M0", "M9"]
MARGIN_FACTOR = 0.75

# Historical quote table as it is stored on disk.
QUOTES_CSV_SCHEMA = T.StructType([
    T.StructField("QuoteID", T.StringType()),
    T.StructField("Date", T.StringType()),
    T.StructField("PartDescription", T.StringType()),
    T.StructField("Material", T.StringType()),
    T.StructField("Process", T.StringType()),
    T.StructField("Quantity", T.StringType()),
    T.StructField("LeadTimeWeeks", T.StringType()),
    T.StructField("RushJob", T.StringType()),
    T.StructField("Estimator", T.StringType()),
    T.StructField("TotalPrice_USD", T.StringType()),
])
EXPECTED_COLUMNS = [f.name for f in QUOTES_CSV_SCHEMA.fields]
