"""Column names, feature lists and thresholds of the incident data model.

Fixed values: these must equal the behaviour being reproduced, so they are
stated plainly and in one place.
"""

from __future__ import annotations

# --- fixed values: column names -------------------------------------------
INCIDENT_DATETIME = "INCIDENT_DATETIME"
FIRST_ON_SCENE_DATETIME = "FIRST_ON_SCENE_DATETIME"
TARGET = "Response_Time_Minutes"
KEY = "CAD_INCIDENT_ID"

REQUIRED_COLUMNS = [INCIDENT_DATETIME, FIRST_ON_SCENE_DATETIME, "BOROUGH"]
OPTIONAL_FEATURE_COLUMNS = ["INCIDENT_DISPATCH_AREA", "ZIPCODE"]

NUMERIC_FEATURES = [
    "Hour",
    "DayOfWeek",
    "Month",
    "INITIAL_SEVERITY_LEVEL_CODE",
    "FINAL_SEVERITY_LEVEL_CODE",
    "DISPATCH_RESPONSE_SECONDS_QY",
    "IsHeld",
    "IsReopen",
]
CYCLICAL_FEATURES = [
    "Hour_sin",
    "Hour_cos",
    "DayOfWeek_sin",
    "DayOfWeek_cos",
    "Month_sin",
    "Month_cos",
]
INTERACTION_FEATURES = [
    "Borough_Hour_Avg",
    "Classification_Severity_Avg",
    "DispatchArea_Hour_Avg",
]
CONTEXTUAL_FEATURES = ["IsWeekend", "IsNight", "IsRushHour"]
TARGET_ENCODED_FEATURES = [
    "Classification_TargetEnc",
    "DispatchArea_TargetEnc",
    "Borough_TargetEnc",
]
ENHANCED_NUMERIC_FEATURES = (
    NUMERIC_FEATURES
    + CYCLICAL_FEATURES
    + INTERACTION_FEATURES
    + CONTEXTUAL_FEATURES
    + TARGET_ENCODED_FEATURES
)
BASE_CATEGORICAL_FEATURES = ["BOROUGH", "INCIDENT_CLASSIFICATION"]
CLASSIFICATION_SOURCE_COLUMNS = [
    "INCIDENT_CLASSIFICATION",
    "FINAL_CALL_TYPE",
    "INITIAL_CALL_TYPE",
]
CASE_METADATA_COLUMNS = [
    "CAD_INCIDENT_ID",
    "INCIDENT_DATETIME",
    "FIRST_ON_SCENE_DATETIME",
    "BOROUGH",
    "INCIDENT_CLASSIFICATION",
    "INCIDENT_DISPATCH_AREA",
    "INITIAL_SEVERITY_LEVEL_CODE",
    "FINAL_SEVERITY_LEVEL_CODE",
]
# Payload fields of a new-incident request (what a caller supplies).
PAYLOAD_COLUMNS = [
    "Hour",
    "DayOfWeek",
    "Month",
    "INITIAL_SEVERITY_LEVEL_CODE",
    "FINAL_SEVERITY_LEVEL_CODE",
    "BOROUGH",
    "INCIDENT_CLASSIFICATION",
    "INCIDENT_DISPATCH_AREA",
    "DISPATCH_RESPONSE_SECONDS_QY",
    "ZIPCODE",
    "IsHeld",
    "IsReopen",
]

# --- fixed values: thresholds and constants --------------------------------
RESPONSE_TIME_MIN = 0.5
RESPONSE_TIME_MAX = 60.0
SLOW_RESPONSE_LIMIT = 15.0
TARGET_SMOOTHING = 20
DISPATCH_CLIP_LOW = 0.0
DISPATCH_CLIP_HIGH = 600.0
RUSH_HOURS = [7, 8, 9, 17, 18, 19]
NIGHT_START_HOUR = 22  # hour >= 22 or hour <= 5 is night
NIGHT_END_HOUR = 5
WEEKEND_FIRST_DAY = 5  # Monday = 0, so 5 and 6 are the weekend
DATETIME_TEXT_FORMAT = "M/d/yyyy h:mm:ss a"  # e.g. 01/31/2024 09:05:00 PM or 1/5/2024 9:05:00 PM
GENERIC_DATETIME_FORMATS = ["yyyy/M/d H:mm[:ss]", "M/d/yyyy H:mm[:ss]", "M/d/yyyy h:mm a", "yyyy/M/d", "M/d/yyyy"]
WHITE_SPACE = " \t\n\r\f\x0b\u00a0"
# Day periods, closed on the right; hour 0 joins the first bin.
DAY_PERIODS = [(6, "night"), (12, "morning"), (18, "noon"), (24, "evening")]
# Dashboard minimum group sizes.
MIN_AREA_CASES = 80
MIN_INCIDENT_CASES = 80
MIN_WORST_AREA_CASES = 20
MIN_TOP_CLASSIFICATION_CASES = 50
LARGE_ERROR_MINUTES = 15.0
# Priority rule for dispatch areas: (extra minutes over the global mean, min slow share).
PRIORITY_HIGH_MARGIN = 1.25
PRIORITY_HIGH_SLOW_SHARE = 0.2
PRIORITY_MEDIUM_MARGIN = 0.5
PRIORITY_LABELS = ["high", "medium", "watch"]
HISTOGRAM_BINS = 50
SEED = 42
TEST_FRACTION = 0.2
MIN_TRAINING_ROWS = 10

# Names of the five learners, in the order they are trained.
MODEL_NAMES = [
    "Linear Regression",
    "Random Forest Regressor",
    "Boosted Trees A",
    "Boosted Trees B",
    "Stacking Ensemble",
]

# Text that counts as a number.
NUMBER_PATTERN = r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf(inity)?)$"
