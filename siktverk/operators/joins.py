"""Joins of annotations, metadata, labels and id sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siktverk.functions.ids import canonical_id


def first_per_key(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """One row a key: the first by ``order``, as one aggregate with map-side combine; columns stay as they are."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*[F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)])
    row = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("_row"))
    return row.select(*keys, "_row.*").select(*df.columns)


def join_metadata(annotations: DataFrame, metadata: DataFrame, key: str = "id", suffix: str = "_meta") -> DataFrame:
    """Inner join; columns of the metadata that also occur in the annotations get a suffix."""
    clash = {c: f"{c}{suffix}" for c in metadata.columns if c in annotations.columns and c != key}
    return annotations.join(metadata.withColumnsRenamed(clash), key)


def join_report(annotations: DataFrame, metadata: DataFrame, key: str = "id") -> DataFrame:
    """One row: rows of both sides, joined rows, and distinct ids of each side without a match.

    Both sides are reduced to one count an id before they meet, so that no repeated id multiplies rows.
    """
    a = annotations.groupBy(key).agg(F.count("*").alias("na"))
    b = metadata.groupBy(key).agg(F.count("*").alias("nb"))
    both = a.join(b, key, "full_outer")
    na, nb = F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))
    return both.agg(
        F.coalesce(F.sum(na), F.lit(0)).alias("annotation_rows"), F.coalesce(F.sum(nb), F.lit(0)).alias("metadata_rows"), F.coalesce(F.sum(na * nb), F.lit(0)).alias("matched_rows"),
        F.count_if((na > 0) & (nb == 0)).alias("unmatched_annotations"), F.count_if((nb > 0) & (na == 0)).alias("unmatched_metadata"),
    )


def load_labels(df: DataFrame) -> DataFrame:
    """``doc_id, gold_score`` from ``id`` or ``doc_id`` and the first of ``gold_score, score, quality_score``, clipped to [0, 1]."""
    key = next((c for c in ("id", "doc_id") if c in df.columns), None)
    score = next((c for c in ("gold_score", "score", "quality_score") if c in df.columns), None)
    if key is None or score is None:
        raise ValueError("labels need an id and a score column")
    s = F.col(score).cast("double")
    return df.select(F.col(key).cast("string").alias("doc_id"), F.when(s.isNotNull(), F.greatest(F.least(s, F.lit(1.0)), F.lit(0.0))).alias("gold_score"))


def attach_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner join by canonical id; labels are made unique first (their largest score), so rows do not multiply."""
    unique = labels.filter("gold_score is not null").groupBy(canonical_id("doc_id").alias("_label_id")).agg(F.max("gold_score").alias("gold_score"))
    return df.join(unique, canonical_id("doc_id") == F.col("_label_id")).drop("_label_id")


def members(df: DataFrame, targets: DataFrame, key: str = "id", target: str = "id") -> DataFrame:
    """Rows whose canonical id is among the targets; no targets mean no filter, as the caller decides by passing None."""
    return df.join(targets.select(canonical_id(target).alias("_target")).distinct(), canonical_id(key) == F.col("_target"), "left_semi")


def without(df: DataFrame, *excluded: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose canonical id is in none of the excluded tables (their first column)."""
    if not excluded:
        return df
    ids = excluded[0].select(canonical_id(excluded[0].columns[0]).alias("_out"))
    for e in excluded[1:]:
        ids = ids.unionByName(e.select(canonical_id(e.columns[0]).alias("_out")))
    return df.join(ids.distinct(), canonical_id(key) == F.col("_out"), "left_anti")


def ordered_left_join(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    return left.join(right, key, "left").orderBy(order)


def band_members(df: DataFrame, group: str, band: str, key: str) -> DataFrame:
    """``group, band, key``: one row a key (its smallest group and band); null keys are left out."""
    row = df.filter(F.col(key).isNotNull() & F.col(group).isNotNull() & F.col(band).isNotNull()).groupBy(key).agg(F.min(F.struct(group, band)).alias("_row"))
    return row.select("_row.*", key)


def band_classes(df: DataFrame, group: str, band: str, key: str, width: int = 1) -> DataFrame:
    """All pairs of :func:`band_pairs` in compact form: ``group, band, key, meets, partners``, one row a key.

    A row's partners are all other keys of its group whose band is in ``meets``; ``partners`` is their number, so the sum of
    it is twice the number of pairs. Its size is that of ``df``.
    """
    rows = band_members(df, group, band, key)
    sizes = rows.groupBy(group, band).agg(F.count("*").alias("_n"))
    other = sizes.select(F.col(group).alias("_g"), F.col(band).alias("_b"), F.col("_n").alias("_m"))
    near = sizes.join(other, (F.col(group) == F.col("_g")) & (F.abs(F.col(band) - F.col("_b")) <= width))
    meets = near.groupBy(group, band).agg(F.sort_array(F.collect_list("_b")).alias("meets"), (F.sum("_m") - 1).alias("partners"))
    return rows.join(meets, [group, band]).select(group, band, key, "meets", "partners")


def band_pairs(df: DataFrame, group: str, band: str, key: str, width: int = 1) -> DataFrame:
    """``group, a, b``: all unordered pairs inside a group whose bands differ by ``width`` at most.

    Their number grows with the square of a group; :func:`band_classes` holds the same relation in compact form.
    """
    rows = band_members(df, group, band, key)
    one, two = rows.select(group, F.col(band).alias("_x"), F.col(key).alias("a")), rows.select(group, F.col(band).alias("_y"), F.col(key).alias("b"))
    return one.join(two, group).filter((F.col("a") < F.col("b")) & (F.abs(F.col("_x") - F.col("_y")) <= width)).select(group, "a", "b")


def aligned_union(base: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all tables in the columns and types of the first; values that cannot be cast become null."""
    out = base
    for o in others:
        out = out.unionByName(o.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in o.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in base.schema.fields]))
    return out
