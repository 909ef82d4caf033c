"""Read fields of a JSON payload held as VARIANT, with the truth rules of the source data's producer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# JSON text of every value that counts as "not there": null, "", 0, false, [] and {}.
FALSY_JSON = r'^(null|""|false|\[\]|\{\}|-?0(\.0*)?([eE][-+]?\d+)?)$'
# The same values read as text; only then does the type have to be looked at.
MAYBE_FALSY_TEXT = r"^(|null|false|\[\]|\{\}|-?0(\.0*)?([eE][-+]?\d+)?)$"


def path(*keys: str) -> str:
    return "$" + "".join(f"['{key}']" for key in keys)


def get(payload: Column, *keys: str) -> Column:
    """The value under nested keys as text: empty strings survive, JSON null and absence are null."""
    return F.try_variant_get(payload, path(*keys), "string")


def truthy(payload: Column, json_path: str) -> Column:
    """The value at a path as text, or null when it is missing or falsy. The string "0" is truthy."""
    text = F.try_variant_get(payload, json_path, "string")
    as_json = F.to_json(F.try_variant_get(payload, json_path, "variant"))
    return F.when(~text.rlike(MAYBE_FALSY_TEXT), text).when(~as_json.rlike(FALSY_JSON), text)


def first(payload: Column, *paths: str) -> Column:
    """The first truthy value among JSON paths."""
    return F.coalesce(*[truthy(payload, p) for p in paths])


def object_or_empty(payload: Column, as_json: Column) -> tuple[Column, Column]:
    """A payload and its JSON text: kept if it is an object, ``{}`` if missing or falsy, else an error."""
    falsy = F.coalesce(as_json.rlike(FALSY_JSON), F.lit(True))
    refused = F.raise_error(F.concat(F.lit("payload is not an object: "), F.substring(as_json, 1, 80)))
    checked = F.when(falsy, F.parse_json(F.lit("{}"))).when(as_json.startswith("{"), payload).otherwise(refused)
    return checked, F.when(falsy, "{}").otherwise(as_json)
