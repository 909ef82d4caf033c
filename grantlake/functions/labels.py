"""Keyword labelling: any hit, all hits, first hit. Every test is a substring test."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that send a question to the eligibility side.
ELIGIBILITY_WORDS = (
    "grant", "grants", "eligible", "eligibility", "qualify", "qualifies",
    "funding", "application", "fund", "program", "scheme",
)
# Words that send a question to the compliance side.
COMPLIANCE_WORDS = (
    "tax", "taxes", "ato", "compliance", "pay", "wage", "wages", "award", "fair work",
    "super", "superannuation", "obligation", "obligations", "employee", "employer", "payroll",
)
# Guidance topics and the words that mark them.
TOPIC_WORDS = {
    "gst": ("gst", "goods and services tax"),
    "payg": ("payg", "pay as you go"),
    "superannuation": ("super", "superannuation"),
    "record_keeping": ("record keeping", "records you need to keep", "recordkeeping"),
}
# Ordered word groups of the demo cascade, first matching group wins.
CASCADE_WORDS = (
    ("award_pay", ("award", "pay rate", "wage", "employee", "hire")),
    ("tax", ("tax", "gst", "payg", "ato", "super")),
)
CASCADE_DEFAULT = "grants"


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True if any word is a substring. Words that hold a shorter listed word add nothing and are left out."""
    words = set(words)
    needed = sorted(w for w in words if not any(o != w and o in w for o in words))
    return any_of(F.contains(text, F.lit(word)) for word in needed)


def question_class(question: Column) -> Column:
    """eligibility, compliance or mixed (both sides hit, or neither)."""
    text = F.lower(F.coalesce(question, F.lit("")))
    eligibility = contains_any(text, ELIGIBILITY_WORDS)
    compliance = contains_any(text, COMPLIANCE_WORDS)
    return (
        F.when(eligibility & ~compliance, "eligibility").when(compliance & ~eligibility, "compliance").otherwise("mixed")
    )


def topic_labels(text: Column, topics: Mapping[str, Sequence[str]] = TOPIC_WORDS) -> Column:
    """Every topic with a keyword in the text, sorted."""
    lowered = F.lower(text)
    hits = [F.when(contains_any(lowered, words), F.lit(topic)) for topic, words in sorted(topics.items())]
    return F.array_compact(F.array(*hits))


def first_label(
    text: Column,
    groups: Sequence[tuple[str, Sequence[str]]] = CASCADE_WORDS,
    default: str = CASCADE_DEFAULT,
) -> Column:
    """The label of the first group with a keyword in the text."""
    lowered = F.lower(text)
    label = None
    for name, words in groups:
        hit = contains_any(lowered, words)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return label.otherwise(default)
