"""Pay rates in award text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from grantlake.functions.text import strip

# The parts of "classification [- :] $amount per period".
CLASSIFICATION = r"[A-Za-z][A-Za-z0-9 /()&\-]*?"
AMOUNT = r"\d+(?:\.\d{1,2})?"
PERIOD = "hour|week|annum|year"

CLASS_CHAR = r"[A-Za-z0-9 /()&\-]"
NON_LETTERS = r"[0-9 /()&\-]*+"
SPACE = r"[\s\x1c-\x1f]*"
# Unicode classes (U) so that a no-break space counts as space. A search may only begin where a run of
# classification characters begins, or where the last match ended: any later start in the same
# run would fail or succeed together with it. That keeps long texts linear.
PAY_RATE = (
    rf"(?iU)(?:\G|(?<!{CLASS_CHAR})){NON_LETTERS}({CLASSIFICATION}){SPACE}[-:]?{SPACE}"
    rf"\$({AMOUNT}){SPACE}per{SPACE}({PERIOD})"
)
PAY_RATE_TYPE = "array<struct<classification:string,amount:double,period:string>>"


# The zero of every run of ten decimal digits that Unicode has.
ZEROS = [c for c in range(0x110000) if unicodedata.decimal(chr(c), None) == 0]
DIGITS = "".join(chr(zero + i) for zero in ZEROS for i in range(10))


def ascii_number(text: Column) -> Column:
    """A number in any script's digits; null if it is none."""
    return F.translate(text, DIGITS, "0123456789" * len(ZEROS)).try_cast("double")


def pay_rates(text: Column) -> Column:
    """All rates of a text in order, as ``array<struct<classification, amount, period>>``."""

    def rate(match: Column) -> Column:
        return F.struct(
            strip(F.regexp_extract(match, PAY_RATE, 1)).alias("classification"),
            ascii_number(F.regexp_extract(match, PAY_RATE, 2)).alias("amount"),
            F.lower(F.regexp_extract(match, PAY_RATE, 3)).alias("period"),
        )

    found = F.transform(F.regexp_extract_all(text, F.lit(PAY_RATE), F.lit(0)), rate)
    return F.when(F.contains(text, F.lit("$")), found).otherwise(F.array()).cast(PAY_RATE_TYPE)
