"""Ordinal domains of the label columns. The ranker and the sampler use different maps; both are kept by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ranker's maps.
RANKER: dict[str, dict[str, int]] = {
    "content_quality": {"unacceptable": 0, "very_low": 0, "poor": 1, "low": 1, "adequate": 2, "medium": 2, "good": 3, "high": 3, "excellent": 4, "very_high": 4},
    "educational_value": {"none": 0, "very_low": 0, "minimal": 1, "low": 1, "basic": 2, "medium": 2, "moderate": 3, "high": 3, "very_high": 4},
    "information_density": {"empty": 0, "very_sparse": 0, "thin": 1, "sparse": 1, "adequate": 2, "moderate": 2, "dense": 3, "very_dense": 4},
    "safety": {"very_unsafe": 0, "unsafe": 1, "mild_concerns": 2, "mixed": 2, "safe": 3, "very_safe": 4},
    "length": {"minimal": 0, "brief": 1, "moderate": 2, "substantial": 3},
}
# The sampler's maps.
SAMPLER: dict[str, dict[str, int]] = {
    "content_quality": {"unacceptable": 0, "poor": 1, "adequate": 2, "good": 3, "excellent": 4},
    "educational_value": {"none": 0, "minimal": 1, "basic": 2, "moderate": 3, "high": 4},
}
# Spellings of the presence of personal data.
PII_PRESENT = ("contains_pii", "has_pii", "pii_present", "true", "1")
PII_ABSENT = ("no_pii", "does_not_contain_pii", "pii_absent", "false", "0")
# Topic families by content type; all other types are informational.
FAMILIES: dict[str, tuple[str, ...]] = {
    "transactional": ("transactional", "press_release", "boilerplate"),
    "creative_conversational": ("creative", "conversational", "opinion_editorial", "review_critique"),
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ordinal(c: Column | str, domain: dict[str, int], trim: bool = False) -> Column:
    """Bigint of a label in lower case; null for unknown labels. ``trim`` also drops surrounding white space."""
    label = F.lower(_col(c).cast("string"))
    if trim:
        label = F.regexp_replace(label, r"^\s+|\s+$", "")
    known = F.create_map(*[F.lit(x) for k, v in domain.items() for x in (k, v)])
    return F.try_element_at(known, label).cast("bigint")


def coerced_ordinal(c: Column | str, domain: dict[str, int]) -> Column:
    """Ordinal of a label or of a number from 0 to 4 written as one; else null."""
    number = _col(c).cast("string").try_cast("double")
    return F.coalesce(ordinal(c, domain, trim=True), F.when(number.between(0, 4), number.cast("bigint")))


def pii_absence(c: Column | str) -> Column:
    label = F.lower(_col(c).cast("string"))
    return F.when(label.isin(*PII_PRESENT), 0).when(label.isin(*PII_ABSENT), 1).cast("bigint")


def topic_family(c: Column | str) -> Column:
    """Family of a content type (the first one of an array column is passed in by the caller)."""
    label = _col(c)
    out = F
    for family, types in FAMILIES.items():
        out = out.when(label.isin(*types), family)
    return out.otherwise("informational")


def coerce_text(c: Column | str, is_array: bool = False) -> Column:
    """Display text: arrays joined by commas, null as empty."""
    return F.coalesce(F.array_join(_col(c), ", ") if is_array else _col(c).cast("string"), F.lit(""))
