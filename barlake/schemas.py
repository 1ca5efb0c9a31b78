"""Table shapes of the measurement model. Scans name their columns; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

IMU_REQUIRED = ("t", "ua_x", "ua_y", "ua_z", "g_x", "g_y", "g_z", "q_w", "q_x", "q_y", "q_z")
IMU_OPTIONAL = ("rr_x", "rr_y", "rr_z", "mf_x", "mf_y", "mf_z")
IMU_COLUMNS = IMU_REQUIRED + IMU_OPTIONAL
IMU = T.StructType([T.StructField(c, T.DoubleType()) for c in IMU_COLUMNS])

HEART_RATE = T.StructType(
    [T.StructField("t", T.DoubleType()), T.StructField("utc", T.TimestampType()), T.StructField("bpm", T.DoubleType())]
)

SET_METADATA = T.StructType([
    T.StructField("lift", T.StringType()), T.StructField("customLiftCode", T.StringType()), T.StructField("setIndex", T.IntegerType()),
    T.StructField("mount", T.StringType()), T.StructField("rpe", T.DoubleType()), T.StructField("load", T.DoubleType()),
    T.StructField("loadUnit", T.StringType()), T.StructField("plateType", T.StringType()), T.StructField("notes", T.StringType()),
])
RECORDING = T.StructType([
    T.StructField("schemaVersion", T.IntegerType()), T.StructField("sessionId", T.StringType()), T.StructField("workoutId", T.StringType()),
    T.StructField("kind", T.StringType()), T.StructField("startedAt", T.StringType()), T.StructField("stoppedAt", T.StringType()),
    T.StructField("clockAnchorUptimeSeconds", T.DoubleType()), T.StructField("exercise", T.StringType()), T.StructField("setMetadata", SET_METADATA),
    T.StructField("sampleRateHintHz", T.IntegerType()), T.StructField("deviceModel", T.StringType()), T.StructField("osVersion", T.StringType()),
    T.StructField("watchOSVersion", T.StringType()), T.StructField("sampleCount", T.IntegerType()), T.StructField("notes", T.StringType()),
])

SETS = T.StructType([
    T.StructField("set_id", T.StringType(), False), T.StructField("date", T.StringType()), T.StructField("lift", T.StringType()),
    T.StructField("load_kg", T.DoubleType()), T.StructField("load_entered", T.DoubleType()), T.StructField("load_unit", T.StringType()),
    T.StructField("set_index", T.IntegerType()), T.StructField("target_reps", T.IntegerType()), T.StructField("actual_reps", T.IntegerType()),
    T.StructField("rpe_actual", T.DoubleType()), T.StructField("notes", T.StringType()),
])
REP_METRICS = T.StructType([
    T.StructField("set_id", T.StringType(), False), T.StructField("vendor", T.StringType(), False), T.StructField("rep_index", T.IntegerType()),
    T.StructField("true_rep", T.IntegerType()), T.StructField("metric", T.StringType(), False), T.StructField("value", T.DoubleType()),
    T.StructField("unit", T.StringType()), T.StructField("flag", T.StringType()), T.StructField("confidence", T.DoubleType()),
])
VIDEO_REP = (
    "rep_index int, t double, t_end double, mean_velocity double, peak_velocity double, rom double, dx_cm double,"
    " pos_start double, pos_end double, flag string"
)

#: Flags that make a row unusable for any measure.
INVALID_FLAGS = ("phantom", "missed")
#: Reference vendors, most trusted first.
VENDOR_PREFERENCE = ("vitruve", "stance", "metric", "smartbarbell", "wl_analysis")
# Lift names by three-letter code.
LIFT_CODES = {"SQ": "squat", "BN": "bench", "IB": "incline_bench", "DL": "deadlift", "ROW": "row", "RDL": "rdl", "SC": "curl"}
