"""Deterministic record ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_HEX_DIGITS = 24


def record_id(source: Column, natural_key: Column) -> Column:
    """``source#`` plus the first hex digits of ``sha256("source:key")``.

    A missing key counts as the empty string, so keyless records of one source share an id.
    """
    key = F.concat(source, F.lit(":"), F.coalesce(natural_key.cast("string"), F.lit("")))
    return F.concat(source, F.lit("#"), F.substring(F.sha2(key, 256), 1, ID_HEX_DIGITS))
