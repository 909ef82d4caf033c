"""Map every source's payload to the one fixed record shape, in a single pass over the raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlake.functions import payload as P
from grantlake.functions.ids import record_id
from grantlake.schemas import NORMALIZED, NORMALIZED_FIELDS, SOURCES

# Fixed values.
DATASET_URL = "https://data.gov.au/dataset/"
DEFAULT_AWARD_CATEGORY = "modern_award"

FIELD_COLUMNS = NORMALIZED_FIELDS[2:10]
PAYLOAD = "payload"


def _get(*keys: str) -> Column:
    return P.get(F.col(PAYLOAD), *keys)


def _first(*keys: str) -> Column:
    return P.first(F.col(PAYLOAD), *[P.path(key) for key in keys])


def _raw_field(*labels: str) -> Column:
    return P.first(F.col(PAYLOAD), *[P.path("raw_fields", label) for label in labels])


def _grant() -> dict[str, Column]:
    return {
        "key": P.first(F.col(PAYLOAD), P.path("url")),
        "url": _get("url"),
        "title": _get("title"),
        "description": _get("description"),
        "eligibility": _raw_field("eligibility", "eligible applicants"),
        "amount": _get("estimated_value"),
        "deadline": _get("closing_date"),
        "category": _get("category"),
        "state_or_territory": _raw_field("location", "state"),
    }


def _dataset() -> dict[str, Column]:
    url = F.concat(F.lit(DATASET_URL), _first("name"))
    return {
        "key": F.coalesce(_first("id"), url),
        "url": url,
        "title": _get("title"),
        "description": _get("notes"),
        "category": F.try_variant_get(F.col(PAYLOAD), "$.tags[0].name", "string"),
        "state_or_territory": _get("organization", "title"),
    }


def _program() -> dict[str, Column]:
    url = _first("url", "link")
    return {
        "key": url,
        "url": url,
        "title": _get("title"),
        "description": _first("description", "summary"),
        "eligibility": _first("eligibility", "who_can_apply"),
        "amount": _first("amount", "funding_amount", "estimated_value"),
        "deadline": _first("deadline", "closing_date"),
        "category": _get("category"),
        "state_or_territory": _first("state_or_territory", "state", "location"),
    }


def _guidance() -> dict[str, Column]:
    url = _first("url", "link")
    return {
        "key": url,
        "url": url,
        "title": _get("title"),
        "description": _first("description", "summary", "content"),
        "category": _first("category", "topic"),
    }


def _award() -> dict[str, Column]:
    url = _first("url", "link")
    return {
        "key": url,
        "url": url,
        "title": _first("title", "award_name"),
        "description": _first("description", "summary"),
        "eligibility": _first("conditions", "coverage"),
        "amount": _first("pay_rate", "amount"),
        "category": F.coalesce(_first("category", "classification"), F.lit(DEFAULT_AWARD_CATEGORY)),
    }


# Per source: the natural ``key`` and the filled record fields; fields left out are null.
# ``_get`` keeps an empty string as it is, ``_first`` skips it and tries the next key.
MAPPINGS = {
    "grantconnect": _grant,
    "data_gov_au": _dataset,
    "business_gov_au": _program,
    "ato": _guidance,
    "fair_work_mapd": _award,
}


def check_source(source: str) -> str:
    if source not in SOURCES:
        raise KeyError(f"source {source!r} has no field mapping")
    return source


def normalize_source(raw: DataFrame, source: str) -> DataFrame:
    """Normalize raw rows that all belong to one source; only its own mapping is in the plan."""
    mapping = MAPPINGS[check_source(source)]()
    fields = [mapping.get(name, F.lit(None)).cast("string").alias(name) for name in FIELD_COLUMNS]
    return _records(raw, F.lit(source), mapping["key"], fields)


def normalize(raw: DataFrame) -> DataFrame:
    """Normalize raw rows of any mix of sources, each by its own mapping; an unknown source is an error."""
    mappings = {source: build() for source, build in MAPPINGS.items()}
    unknown = F.raise_error(F.concat(F.lit("no field mapping for source "), F.col("source")))

    def pick(name: str, default: Column) -> Column:
        choice = F
        for source, mapping in mappings.items():
            if name in mapping:
                choice = choice.when(F.col("source") == source, mapping[name].cast("string"))
        return choice.otherwise(default)

    fields = [pick(name, F.lit(None)).alias(name) for name in FIELD_COLUMNS]
    source = F.when(F.col("source").isin(*SOURCES), F.col("source")).otherwise(unknown)
    return _records(raw, source, pick("key", F.lit(None)), fields)


def _records(raw: DataFrame, source: Column, key: Column, fields: list[Column]) -> DataFrame:
    """The record columns, then any further input column (an ordinal, a partition) unchanged."""
    extra = [c for c in raw.columns if c not in ("source", "payload", "fetched_at")]
    payload, as_json = P.object_or_empty(F.col(PAYLOAD), F.col("raw"))
    checked = raw.withColumn("raw", F.to_json(PAYLOAD)).select(
        "source", payload.alias(PAYLOAD), as_json.alias("raw"), "fetched_at", *extra
    )
    return checked.select(
        record_id(source, key).alias("record_id"),
        source.alias("source"),
        *fields,
        F.col("fetched_at").alias("ingested_at"),
        "raw",
        *extra,
    )


def record_json(records: DataFrame) -> DataFrame:
    """One JSON line per record, nulls written out, the payload nested as an object again."""
    nested = F.parse_json(F.coalesce("raw", F.lit("{}"))).alias("raw")
    row = F.struct(*NORMALIZED.fieldNames()[:-1], nested)
    return records.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))
