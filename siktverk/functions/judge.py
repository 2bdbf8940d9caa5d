"""Scores of a model judge: parsing of answers and combination of the two axes."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("educational_value", "content_quality")
_NUMBER = r"(-?\d+(?:\.\d+)?)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: Column) -> Column:
    """To [0, 1]; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)))


def parsed_score(raw: Column | str, axis: str) -> Column:
    """Score of one axis in a judge's answer, clamped to [0, 1]; null where there is none.

    The first of: a JSON object without nested objects anywhere in the text, the whole text as JSON, and ``axis: number``
    in any case, with blanks or underscores between the words.
    """
    text = F.trim(_col(raw))
    value = lambda x: F.get_json_object(x, f"$.{axis}").try_cast("double")
    objects = F.transform(F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), F.lit(1)), value)
    first = F.get(F.filter(objects, lambda x: x.isNotNull()), F.lit(0))
    loose = F.regexp_extract(text, "(?i)" + axis.replace("_", r"[_\s]*") + r"['\"]?\s*[:=]\s*" + _NUMBER, 1).try_cast("double")
    return clamp(F.coalesce(first, value(text), loose))


def combined_score(education: Column | str, quality: Column | str) -> Column:
    """Mean of both axes; null if either is."""
    return (_col(education) + _col(quality)) / 2


def parse_scores(raw: str | None) -> tuple[float | None, float | None]:
    """:func:`parsed_score` of both axes for one answer, where a call has to know whether to ask again."""
    text = (raw or "").strip()
    read: list[dict] = []
    for part in [*re.findall(r"\{[^{}]*\}", text), text]:
        try:
            if isinstance(x := json.loads(part), dict):
                read.append(x)
        except ValueError:
            pass

    def number(x: object) -> float | None:
        try:
            return None if x is None or isinstance(x, bool) else min(max(float(x), 0.0), 1.0)
        except (TypeError, ValueError):
            return None

    out = []
    for axis in AXES:
        value = next((v for x in read if (v := number(x.get(axis))) is not None), None)
        if value is None and (m := re.search(axis.replace("_", r"[_\s]*") + r"['\"]?\s*[:=]\s*" + _NUMBER, text, re.I)):
            value = number(m[1])
        out.append(value)
    return out[0], out[1]
