"""Business constants of the river water-quality domain.

Everything in this module is a fixed value: results are only right when they
equal the published index definition and station register.
"""

from __future__ import annotations

from datetime import date

# --- fixed values: parameters and index weights (sum 1.00) -----------------
PARAMETERS = ("do_", "bod", "cod", "an", "tss", "ph")
WQI_WEIGHTS = {
    "do_": 0.22,
    "bod": 0.19,
    "cod": 0.16,
    "an": 0.15,
    "tss": 0.16,
    "ph": 0.12,
}

# --- fixed values: status bands --------------------------------------------
CLEAN_MIN = 81.0
SLIGHT_MIN = 60.0
CLEAN = "clean"
SLIGHT = "slightly_polluted"
POLLUTED = "polluted"
UNKNOWN = "unknown"
STATUSES = (CLEAN, SLIGHT, POLLUTED)
STATUS_LABELS = {
    CLEAN: "Clean",
    SLIGHT: "Slightly Polluted",
    POLLUTED: "Polluted",
    UNKNOWN: "Unknown",
}

# --- fixed values: station register ----------------------------------------
STATIONS = (
    # code, river, latitude, longitude
    ("S01", "Sungai Klang", 3.1390, 101.6869),
    ("S02", "Sungai Gombak", 3.2330, 101.7240),
    ("S03", "Sungai Pinang", 5.4141, 100.3288),
    ("S04", "Sungai Kulim", 5.6710, 100.5660),
    ("S05", "Sungai Perak", 4.5921, 101.0901),
    ("S06", "Sungai Sarawak", 1.5533, 110.3592),
    ("S07", "Sungai Kinabatangan", 5.5000, 118.0000),
)
RIVER_BY_CODE = {code: river for code, river, _, _ in STATIONS}
CODE_BY_RIVER = {river: code for code, river, _, _ in STATIONS}
RIVER_BY_BASIN = {
    "KULIM": "Sungai Kulim",
    "KLANG": "Sungai Klang",
    "PINANG": "Sungai Pinang",
    "PENANG": "Sungai Pinang",
    "PERAK": "Sungai Perak",
    "GOMBAK": "Sungai Gombak",
    "MUDA": "Sungai Muda",
    "SARAWAK": "Sungai Sarawak",
    "KINABATANGAN": "Sungai Kinabatangan",
}
UNKNOWN_RIVER = "Unknown River"
MULTIPLE_RIVERS = "Multiple rivers"
MAP_CENTRE = (5.364, 100.562)
MAP_OFFSETS = ((0, 0), (0.02, 0.01), (-0.02, 0.01), (0.01, -0.02), (-0.01, -0.02), (0.03, 0), (-0.03, 0))

# --- fixed values: header synonyms ------------------------------------------
HEADER_ALIASES = {
    "do": "do_",
    "do_mg_l": "do_",
    "dissolved_oxygen": "do_",
    "bod": "bod",
    "bod_mg_l": "bod",
    "bod5": "bod",
    "cod": "cod",
    "cod_mg_l": "cod",
    "nh3_n": "an",
    "nh3_n_mg_l": "an",
    "an": "an",
    "ammoniacal_nitrogen": "an",
    "tss": "tss",
    "tss_mg_l": "tss",
    "total_suspended_solids": "tss",
    "ss": "tss",
    "ph": "ph",
}
DATE_HEADERS = ("date", "reading_date", "timestamp", "SMP-DAT", "SMP_DAT", "Tarikh")
CODE_HEADERS = (
    "station_code", "Station Code", "station", "ID STN BARU", "ID STN (2016)", "ID STN(2016)", "ID_STN",
    "LOCATION", "SUNGAI",
)
NAME_HEADERS = ("LOCATION", "Station Name", "station_name", "SUNGAI")
RIVER_HEADERS = ("river_name", "River Name", "River")
BASIN_HEADERS = ("SUNGAI",)
STATUS_HEADERS = ("River Status", "river_status", "Status", "RIVER\nSTATUS", "CLASS")
DEFAULT_STATION = "S01"

# --- fixed values: policy defaults (always overridable arguments) ------------
CUTOFF_YEAR = 2025
FORECAST_END = date(2026, 12, 31)
ALERT_HORIZON_DAYS = 7

# --- fixed values: feature engineering ---------------------------------------
ROLLING_ROWS = 7
LAG_ROWS = (1, 7, 14)
MODEL_LAGS = (1, 7, 30)
NE_MONSOON_MONTHS = (10, 11, 12, 1, 2, 3)
SW_MONSOON_MONTHS = (5, 6, 7, 8, 9)
RAINY_MONTHS = (1, 2, 3, 10, 11, 12)
RAINY_DELTA = -0.5
DRY_DELTA = 0.3
LEAKY_TOKENS = ("status", "label", "class", "target", "wqi", "lag", "rolling", "anomaly", "forecast", "predict")

# --- fixed values: alert texts -------------------------------------------------
ALERT_ADVICE = {SLIGHT: "Monitor closely", POLLUTED: "Immediate attention required"}
SEVERITY_ORDER = ("critical", "warning", "info")
ANOMALY_REASON = "Abnormal spike"
NO_COVERAGE_LABEL = "No dated readings"
