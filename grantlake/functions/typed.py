"""Typed views of the free-text amount and deadline fields. The text columns stay untouched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMATS = ("d MMMM yyyy", "yyyy-MM-dd")
AMOUNT_PATTERN = r"\$\s*([0-9][0-9,]*(?:\.[0-9]+)?)"


def deadline_date(deadline: Column) -> Column:
    """The deadline as a date if it is written in a known form, else null."""
    return F.coalesce(*[F.try_to_timestamp(deadline, F.lit(form)) for form in DATE_FORMATS]).cast("date")


def amount_value(amount: Column) -> Column:
    """The first dollar figure of the amount text, else null."""
    digits = F.regexp_replace(F.regexp_extract(amount, AMOUNT_PATTERN, 1), ",", "")
    return F.nullif(digits, F.lit("")).try_cast("decimal(18,2)")
