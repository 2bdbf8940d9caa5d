"""Document identity: one canonical form for every spelling of an id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Envelope around a bare id.
ENVELOPE = r"^<?urn:uuid:(.*?)>?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical_id(c: Column | str) -> Column:
    """Id without the ``<urn:uuid:...>`` envelope. Null stays null; case and blanks stay."""
    return F.regexp_replace(_col(c), r"^<urn:uuid:(.*)>$", "$1")


def bare_id(c: Column | str) -> Column:
    """Canonical id in lower case without surrounding white space; null stays null."""
    trimmed = F.lower(F.regexp_replace(_col(c), r"^\s+|\s+$", ""))
    return F.regexp_replace(trimmed, ENVELOPE, "$1")


def wrapped_id(c: Column | str) -> Column:
    return F.concat(F.lit("<urn:uuid:"), canonical_id(c), F.lit(">"))


def lookup_forms(c: Column | str) -> Column:
    """Every spelling under which an id may be stored: raw, canonical and wrapped."""
    return F.array_distinct(F.array(_col(c), canonical_id(c), wrapped_id(c)))


def hash_fraction(c: Column | str) -> Column:
    """Uniform fraction in [0,1) with four digits, from the first 32 bits of SHA-256."""
    head = F.conv(F.substring(F.sha2(_col(c), 256), 1, 8), 16, 10).cast("bigint")
    return (head % 10000) / F.lit(10000.0)


def hash_split(c: Column | str, train: float = 0.8, validation: float = 0.1) -> Column:
    """``train``, ``val`` or ``test`` by the hash fraction of the id."""
    u = hash_fraction(c)
    cut = round((train + validation) * 10000) / 10000
    return F.when(u < train, "train").when(u < cut, "val").when(u.isNotNull(), "test")


def hash_key(c: Column | str) -> Column:
    """Sixteen hex digits of SHA-256 of the canonical id: a tie-break that sorts like an unsigned 64-bit integer."""
    return F.substring(F.sha2(canonical_id(c), 256), 1, 16)


def seeded_order(c: Column | str, seed: int) -> Column:
    """Hex key for a reproducible shuffle; depends on the seed and the id alone."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), _col(c)), 256)


def named_uuid(c: Column | str) -> Column:
    """A UUID made from a name: equal names give equal ids, so that a repeated run gives the same rows."""
    h = F.sha2(_col(c), 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("8"), part(14, 3)), F.concat(F.lit("a"), part(18, 3)), part(21, 12))


def random_uuid() -> Column:
    """A random UUID, another one in every run."""
    return F.uuid()
