"""Fixed table shapes. Nothing in the library infers a schema."""

from pyspark.sql import types as T

SOURCES = ("grantconnect", "data_gov_au", "business_gov_au", "ato", "fair_work_mapd")

RAW_DDL = "source string, payload variant, fetched_at string"

NORMALIZED_FIELDS = (
    "record_id",
    "source",
    "title",
    "description",
    "eligibility",
    "amount",
    "deadline",
    "category",
    "state_or_territory",
    "url",
    "ingested_at",
)

# `raw` is the payload as canonical JSON text (keys sorted), see functions/payload.py.
NORMALIZED = T.StructType(
    [T.StructField(name, T.StringType(), name not in ("record_id", "source")) for name in NORMALIZED_FIELDS]
    + [T.StructField("raw", T.StringType(), True)]
)

REPORT = T.StructType(
    [
        T.StructField("run_date", T.StringType(), False),
        T.StructField("stage", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("n_records", T.LongType(), True),
        T.StructField("error", T.StringType(), True),
    ]
)

CKAN_BODY_DDL = "success boolean, result struct<count: bigint, results: array<variant>>"
