"""From label columns to model features: ordinals, hard filter, percentile normalization, deduplication signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siktverk.functions.domains import RANKER, ordinal, pii_absence
from siktverk.operators.ordering import running_counts

FEATURES = ("content_quality", "information_density", "educational_value", "safety", "pii_absence", "length", "language_confidence")
#: Statistics of one column: first and 99th percentile, mean, standard deviation.
Stats = dict[str, dict[str, float]]


def first_present(df: DataFrame, *names: str) -> Column:
    """The first non-null of the columns that exist; null if none does."""
    found = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def to_features(df: DataFrame) -> DataFrame:
    """Adds ``doc_id``, the seven features and the two counts (null as 0). Missing label columns give null features."""
    label = {
        "content_quality": first_present(df, "content_quality"),
        "information_density": first_present(df, "information_density"),
        "educational_value": first_present(df, "educational_value"),
        "safety": first_present(df, "safety", "content_safety"),
        "length": first_present(df, "content_length"),
    }
    new = {k: ordinal(c, RANKER[k]) for k, c in label.items()}
    new["pii_absence"] = pii_absence(first_present(df, "pii_presence"))
    new["language_confidence"] = first_present(df, "full_doc_lid_score").cast("double")
    for k in ("minhash_cluster_size", "duplicate_count"):
        new[k] = F.coalesce(first_present(df, k).cast("double"), F.lit(0.0))
    new["doc_id"] = F.col("id")
    return df.withColumns(new)


def hard_filter(df: DataFrame, expected_lid: str | None = None, minimum: dict[str, float] | None = None, require_pii_absence: bool | None = None) -> DataFrame:
    """Adds ``passed_hard_filter``; rows stay. Null, where a needed value is null and nothing else fails, counts as not passed."""
    tests = [F.col("full_doc_lid") == expected_lid] if expected_lid is not None else []
    tests += [F.col(k) >= v for k, v in (minimum or {}).items()]
    if require_pii_absence is not None:
        tests.append(F.col("pii_absence") == int(require_pii_absence))
    return df.withColumn("passed_hard_filter", reduce(lambda a, b: a & b, tests, F.lit(True)))


def nearest_rank_stats(df: DataFrame, columns: list[str]) -> Stats:
    """``p1, p99`` (the value at position round(q (n - 1))), ``mean`` and ``std`` of each column, nulls left out.

    From value histograms with distributed running counts; four numbers a column reach the driver. An empty column gives
    0, 0, 0, 1; a column with ``p99 <= p1`` gets ``p99 = p1 + 1``.
    """
    values = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]))).filter("value is not null")
    counts = values.groupBy("feature", "value").agg(F.count("*").alias("n"))
    ranked = running_counts(counts, "feature", "value", "n")
    at = lambda q: F.round((F.col("total") - 1) * q).cast("bigint")
    pick = lambda q: F.max(F.when((F.col("before") <= at(q)) & (at(q) < F.col("before") + F.col("n")), F.col("value")))
    n, v = F.col("n"), F.col("value")
    rows = ranked.groupBy("feature").agg(pick(0.01).alias("p1"), pick(0.99).alias("p99"), F.sum(n).alias("c"), F.sum(n * v).alias("s"), F.sum(n * v * v).alias("ss")).collect()
    out = {c: {"p1": 0.0, "p99": 1.0, "mean": 0.0, "std": 1.0} for c in columns}
    for r in rows:
        mean = r["s"] / r["c"]
        variance = max(0.0, (r["ss"] - r["c"] * mean * mean) / (r["c"] - 1)) if r["c"] > 1 else 0.0
        out[r["feature"]] = {"p1": r["p1"], "p99": r["p99"] if r["p99"] > r["p1"] else r["p1"] + 1.0, "mean": mean, "std": variance**0.5 or 1.0}
    return out


def scaled(c: Column, s: dict[str, float]) -> Column:
    """(x - p1) / (p99 - p1) in [0, 1]; null stays null."""
    z = (c - s["p1"]) / (s["p99"] - s["p1"])
    return F.when(c.isNotNull(), F.greatest(F.least(z, F.lit(1.0)), F.lit(0.0)))


def normalize(df: DataFrame, stats: Stats, columns: tuple[str, ...] | list[str] = FEATURES) -> DataFrame:
    return df.withColumns({f"{c}_z": scaled(F.col(c), stats[c]) for c in columns})


def dedup_logs() -> dict[str, Column]:
    return {"log_cluster": F.log1p("minhash_cluster_size"), "log_duplicates": F.log1p("duplicate_count")}


def add_dedup_features(df: DataFrame, stats: Stats | None = None) -> DataFrame:
    """``inverted_cluster_size`` and ``inverted_duplicate_count``: 1 - scaled log counts, statistics over all rows."""
    logs = dedup_logs()
    df = df.withColumns(logs)
    stats = stats or nearest_rank_stats(df, list(logs))
    return df.withColumns({"inverted_cluster_size": 1 - scaled(F.col("log_cluster"), stats["log_cluster"]), "inverted_duplicate_count": 1 - scaled(F.col("log_duplicates"), stats["log_duplicates"])}).drop(*logs)


def add_interactions(df: DataFrame, unit: dict[str, float]) -> DataFrame:
    return df.withColumns({f"ux_{f}": F.col(f"{f}_z") * unit[f] for f in FEATURES})


def matrix_columns() -> list[str]:
    """The 17 columns that the second-stage models see."""
    return [*(f"{f}_z" for f in FEATURES), "z_l1", *(f"ux_{f}" for f in FEATURES), "inverted_cluster_size", "inverted_duplicate_count"]


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
