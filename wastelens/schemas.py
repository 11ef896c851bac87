"""Declared schemas, closed value lists and default dimension rows.

Logs are always read with these schemas, never with inference (an 8-hex id
such as ``00012345`` or ``0e712345`` must stay text).
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: must equal the reference for equal results ------------
# Suites: Commercial-1601 .. Commercial-1612, Clinical-1501 .. Clinical-1504,
# then "C Space", "D Space".
SUITES = ([f"Commercial-{i}" for i in range(1601, 1613)]
          + [f"Clinical-{i}" for i in range(1501, 1505)]
          + ["C Space", "D Space"])

REASONS = ["Damage during handling", "Contamination", "Expired",
           "Process loss", "Calibration/test loss", "Operator error", "Other"]

SHIFTS = ["MFG-A Shift Day", "MFG-A Shift Night",
          "MFG-B Shift Day", "MFG-B Shift Night",
          "MSAT", "QC", "QO"]

# (name, unit, cost_per_unit)
DEFAULT_MATERIALS = [
    ("Brauns Red Caps", "ea", 0.35),
    ("50 mL Conical Tubes", "ea", 0.20),
    ("EV3000 Bag", "ea", 65.00),
    ("5L Labtainer Bags", "ea", 120.00),
    ("EV1000 Bag", "ea", 45.00),
    ("MS-450 Manifold", "ea", 85.00),
    ("1000mL Vacuum Filter Unit", "ea", 12.00),
    ("Lovo Kit", "ea", 450.00),
    ("Lovo Ancillary Bag", "ea", 80.00),
    ("Manifold", "ea", 50.00),
]

# Keyword rules, checked in this order; the first category with any
# contained keyword wins.
DEFAULT_RULES = [
    ("utilities", ["electric", "water", "utility", "sewer", "waste mgmt"]),
    ("software", ["license", "saas", "subscription", "cloud", "azure", "aws", "gcp"]),
    ("supplies", ["gloves", "tubes", "pipette", "label", "sticker", "cleanroom", "wipe"]),
    ("logistics", ["shipping", "freight", "ups", "fedex", "dhl", "courier"]),
]

# Canonical column -> accepted source names, first match wins (case-insensitive).
CANON = [
    ("date", ["date", "event_ts", "timestamp"]),
    ("suite", ["suite", "area", "area_code"]),
    ("material", ["material", "item", "sku", "name"]),
    ("vendor", ["vendor", "merchant", "supplier", "payee"]),
    ("qty", ["qty", "quantity", "amount_units"]),
    ("cost", ["cost", "amount", "price", "value", "usd"]),
    ("category", ["category", "cat", "type"]),
    ("description", ["description", "memo", "note", "reason"]),
    ("lot", ["lot", "batch", "batch_id"]),
]

# The 21 fields of the row digest, in digest order (the digest itself is
# the 22nd column of the log).
DIGEST_FIELDS = ["id", "timestamp_local", "date", "time", "site", "suite", "line",
                 "room", "shift", "employee_id", "material", "unit", "quantity",
                 "reason", "batch_lot", "cost_per_unit", "total_cost", "notes",
                 "photo_filename", "sop_url", "prev_hash"]

REPORT_GRAINS = ["Weekly", "Monthly", "Quarterly", "Annual"]

RECOMMENDATION = ("Recommendations: Review high-cost anomalies, confirm subscription-like "
                  "merchants, and enforce standardized reason codes for better root-cause "
                  "analytics.")

ANOMALY_LABEL, NORMAL_LABEL = "\U0001F6A8 Waste Risk", "✅ Normal"
# --- end of fixed values -------------------------------------------------

LOG_COLUMNS = DIGEST_FIELDS[:-1] + ["prev_hash", "hash"]

_LOG_TYPES = {"quantity": T.LongType(), "cost_per_unit": T.DoubleType(),
              "total_cost": T.DoubleType(), "timestamp_local": T.TimestampType()}

LOG_SCHEMA = T.StructType([T.StructField(c, _LOG_TYPES.get(c, T.StringType()), True)
                           for c in LOG_COLUMNS])

# All-text form, used to read CSV logs before typed coercion and for digests.
LOG_TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in LOG_COLUMNS])
