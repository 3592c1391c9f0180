"""Declared schemas and the fixed values the results depend on."""
from __future__ import annotations

from pyspark.sql import types as T

ID = "IDpol"
CLAIM_NB = "ClaimNb"
EXPOSURE = "Exposure"
AMOUNT = "ClaimAmount"

CATEGORICAL = ["VehBrand", "VehGas", "Area", "Region"]
NUMERIC = ["VehPower", "VehAge", "DrivAge", "BonusMalus", "Density"]

POLICY = T.StructType([
    T.StructField("IDpol", T.LongType()),
    T.StructField("ClaimNb", T.IntegerType()),
    T.StructField("Exposure", T.DoubleType()),
    T.StructField("VehPower", T.IntegerType()),
    T.StructField("VehAge", T.IntegerType()),
    T.StructField("DrivAge", T.IntegerType()),
    T.StructField("BonusMalus", T.IntegerType()),
    T.StructField("Density", T.IntegerType()),
    T.StructField("VehBrand", T.StringType()),
    T.StructField("VehGas", T.StringType()),
    T.StructField("Area", T.StringType()),
    T.StructField("Region", T.StringType()),
])

# Raw policy file as read before coercion: numerics that may hold junk stay strings.
POLICY_RAW = T.StructType([
    T.StructField(f.name, T.StringType() if f.name in ("ClaimNb", "Exposure") else f.dataType)
    for f in POLICY.fields
])

CLAIM = T.StructType([
    T.StructField("IDpol", T.LongType()),
    T.StructField("ClaimAmount", T.DoubleType()),
])
CLAIM_RAW = T.StructType([
    T.StructField("IDpol", T.LongType()),
    T.StructField("ClaimAmount", T.StringType()),
])

QUOTE = T.StructType([
    T.StructField("VehPower", T.IntegerType()),
    T.StructField("VehAge", T.IntegerType()),
    T.StructField("DrivAge", T.IntegerType()),
    T.StructField("BonusMalus", T.IntegerType()),
    T.StructField("Density", T.IntegerType()),
    T.StructField("VehBrand", T.StringType()),
    T.StructField("VehGas", T.StringType()),
    T.StructField("Area", T.StringType()),
    T.StructField("Region", T.StringType()),
])

STAT_ROW = T.StructType([
    T.StructField("ITM_NM", T.StringType()),
    T.StructField("C1_NM", T.StringType()),
    T.StructField("C2_NM", T.StringType()),
    T.StructField("DT", T.StringType()),
    T.StructField("errMsg", T.StringType()),
])

# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the reference's values for equal results.
# ---------------------------------------------------------------------------

# Preprocessing parameters.
CAP_CLAIM_NB = 4
CAP_EXPOSURE = 1.0
SEVERITY_CLIP_QUANTILE = 0.995
EXPOSURE_FLOOR = 1e-6

# Quote defaults and ranges (field: default, minimum, maximum or None).
QUOTE_DEFAULTS = {
    "VehPower": 6, "VehAge": 2, "DrivAge": 40, "BonusMalus": 50, "Density": 1000,
    "VehBrand": "B1", "VehGas": "Regular", "Area": "C", "Region": "R24",
}
QUOTE_RANGES = {
    "VehPower": (1, None), "VehAge": (0, None), "DrivAge": (16, None),
    "BonusMalus": (50, 350), "Density": (0, None),
}

# Driver age bands, left-closed: <20, 20s, 30s, 40s, 50s, 60s, 70+.
AGE_BANDS = ["<20", "20s", "30s", "40s", "50s", "60s", "70+"]
AGE_EDGES = [20, 30, 40, 50, 60, 70]

# BonusMalus bands [0,60) [60,80) [80,100) [100,150) [150,1e9), en-dash labels.
BONUS_EDGES = [0, 60, 80, 100, 150, 1e9]
BONUS_LABELS = ["50–59", "60–79", "80–99", "100–149", "150+"]

# Vehicle age bands [0,2) [2,6) [6,11) [11,16) [16,1e9).
VEHAGE_EDGES = [0, 2, 6, 11, 16, 1e9]
VEHAGE_LABELS = ["0–1", "2–5", "6–10", "11–15", "16+"]

# Display order of bands per rating factor, and chart titles.
BAND_ORDER = {
    "DrivAge": AGE_BANDS,
    "BonusMalus": BONUS_LABELS,
    "VehAge": VEHAGE_LABELS,
    "Area": ["A", "B", "C", "D", "E", "F"],
    "VehGas": ["Diesel", "Regular"],
}
FACTOR_TITLES = {
    "DrivAge": "운전자 나이",
    "BonusMalus": "할인할증(BonusMalus)",
    "VehAge": "차령",
    "Area": "지역코드",
    "VehGas": "연료",
}
FACTORS = ["DrivAge", "BonusMalus", "VehAge", "Area", "VehGas"]

# Coverage tiers by risk percentile (>=70 high, >=30 standard, else low).
TIER_HIGH_FROM = 70
TIER_STANDARD_FROM = 30
COVERAGE = {
    "high_risk": ("상향(보험료 절감)", "필수 담보 중심"),
    "standard": ("표준", "표준 패키지"),
    "low_risk": ("낮춤 가능", "보장 확대 여력"),
}
DISCLAIMER = "순보험료는 리스크 원가이며 실제 청구 보험료와 다릅니다."

# Cohort labels: "<band> · Area <area>", "<band> 연령대", "전체 시장".
COHORT_AREA_SEP = " · Area "
COHORT_AGE_SUFFIX = " 연령대"
COHORT_OVERALL = "전체 시장"
COHORT_MIN_COUNT = 30

# Gross-up loading.
EXPENSE_RATIO = 0.25
PROFIT_MARGIN = 0.05

# Prediction floors.
SEVERITY_FLOOR = 1e-3
PREMIUM_FLOOR = 1e-8
COUNT_FLOOR = 1e-8
TWEEDIE_FLOOR = 1e-6

# Raking: driver-age target margin (licence holders, 2024) and gender margin.
DRIVAGE_TARGET = {"<20": 0.007, "20s": 0.130, "30s": 0.179, "40s": 0.209,
                  "50s": 0.226, "60s": 0.177, "70+": 0.072}
GENDER_TARGET = {"Male": 0.566, "Female": 0.434}
RAKING_MAX_ITER = 50
RAKING_TOL = 1e-6

# Dataset mappings for raking: margin -> (source column, transform, spec).
RAKING_DATASETS = {
    "fremtpl2": {"DrivAge": ("DrivAge", "age_band", {})},
    "ausprivauto": {"Gender": ("Gender", "value_map",
                               {"map": {"Male": "Male", "Female": "Female",
                                        "M": "Male", "F": "Female"}})},
}

# Statistics rows: total marker, gender labels, vehicle types and uses.
STAT_TOTAL = "총계"
STAT_MALE = "남자"
STAT_FEMALE = "여자"
VEHICLE_ALL = "계"
VEHICLE_TYPES = ["승용", "승합", "화물", "특수"]
PASSENGER = "승용"
PASSENGER_USES = ["자가용", "영업용", "관용"]

# Tweedie power grid.
TWEEDIE_POWER_GRID = [1.5, 1.6, 1.7, 1.8, 1.9]
# boosted trees: rounds that end by patience, fixed rounds of the power search and of the Tweedie model
GBM_ROUNDS = 2000
GBM_PATIENCE = 50
GBM_RATE = 0.05
GBM_ROW_FRACTION = 0.8
GBM_FEATURE_FRACTION = 0.8
SEARCH_ROUNDS = 150
SEARCH_FOLDS = 3
TWEEDIE_ROUNDS = 100
