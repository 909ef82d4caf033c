"""Resolve link targets against a site origin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORIGIN = r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+)"
HAS_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"
HAS_DOT_SEGMENT = r"/\.\.?(/|$)"


def origin(url: Column) -> Column:
    return F.regexp_extract(url, ORIGIN, 1)


def _without_dot_segments(path: Column) -> Column:
    """Fold ``.`` and ``..`` segments of an absolute path; a trailing one leaves a trailing slash."""
    segments = F.split(F.regexp_replace(path, r"(/\.\.?)$", "$1/"), "/")

    def fold(kept: Column, segment: Column) -> Column:
        parent = F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
        return F.when(segment == "..", parent).when(segment == ".", kept).otherwise(F.array_append(kept, segment))

    return F.array_join(F.aggregate(segments, F.array().cast("array<string>"), fold), "/")


def resolve(href: Column, base: Column) -> Column:
    """The absolute form of ``href`` on a page of the bare origin ``base``."""
    target = F.ltrim(href)
    absolute_path = F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target))
    path = F.regexp_extract(absolute_path, r"^([^?#]*)", 1)
    rest = F.regexp_extract(absolute_path, r"^[^?#]*(.*)$", 1)
    clean = F.when(path.rlike(HAS_DOT_SEGMENT), _without_dot_segments(path)).otherwise(path)
    return (
        F.when(target.rlike(HAS_SCHEME), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]+:)", 1), target))
        .when(target.startswith("?") | target.startswith("#"), F.concat(base, target))
        .otherwise(F.concat(base, clean, rest))
    )
