"""The staged ranking: linear scores of all survivors, a second score of the best candidates, the top k."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siktverk.operators.features import FEATURES, add_dedup_features, add_interactions, dedup_logs, hard_filter, nearest_rank_stats, normalize, to_features
from siktverk.operators.ordering import numbered
from siktverk.sources.durable import durable

# The prototype weights of both stages.
L1_WEIGHTS = {"content_quality": 1.25, "information_density": 1.05, "educational_value": 1.25, "safety": 1.15, "pii_absence": 0.95, "length": 0.70, "language_confidence": 0.95}
L2_WEIGHTS = {"inverted_cluster_size": 0.35, "inverted_duplicate_count": 0.35}
OUTPUT = ("doc_id", "passed_hard_filter", "rank_l1", "z_l1", "rank_l2", "score_l2", "in_top_k", "minhash_cluster_size", "duplicate_count")


@dataclass(frozen=True)
class Linear:
    """Weights of the first stage; ``w_max`` is the default strength of a personal priority."""

    weights: dict[str, float]
    intercept: float = 0.0

    @property
    def w_max(self) -> float:
        return max(map(abs, self.weights.values()))

    def score(self, unit: dict[str, float] | None = None, mu: float | None = None) -> Column:
        """x.w + mu (x.u) + b over the scaled features in fixed order, null features as 0, rounded to 9 digits."""
        mu = 0.0 if unit is None else self.w_max if mu is None else mu
        out = F.lit(0.0)
        for f in FEATURES:
            out = out + F.coalesce(F.col(f"{f}_z"), F.lit(0.0)) * (self.weights[f] + mu * (unit[f] if unit else 0.0))
        return F.round(out + self.intercept, 9)


PROTOTYPE = Linear(L1_WEIGHTS)


def prepare(df: DataFrame, expected_lid: str | None = "swe_Latn", minimum: dict[str, float] | None = None, require_pii_absence: bool | None = None, unit: dict[str, float] | None = None) -> DataFrame:
    """Features, filter flag, scaled features (statistics of the survivors), interactions and deduplication features (of all rows)."""
    flagged = durable(hard_filter(to_features(df), expected_lid, minimum, require_pii_absence))
    logs = dedup_logs()
    values = flagged.select(*[F.when(F.col("passed_hard_filter"), F.col(f)).alias(f) for f in FEATURES], *[c.alias(k) for k, c in logs.items()])
    stats = nearest_rank_stats(values, [*FEATURES, *logs])  # both kinds of statistics at once
    unit = unit or {f: 1 / len(FEATURES) for f in FEATURES}
    return add_dedup_features(add_interactions(normalize(flagged, stats), unit), stats)


def rank_l1(df: DataFrame, model: Linear = PROTOTYPE, unit: dict[str, float] | None = None, mu: float | None = None) -> DataFrame:
    """Adds ``z_l1`` and the 1-based ``rank_l1`` of survivors, ties by ``doc_id``; both are null for the others.

    Only ``doc_id`` and ``z_l1`` need an order; rows keep one rank each, also when ids repeat.
    """
    scored = df.withColumn("z_l1", F.when(F.col("passed_hard_filter"), model.score(unit, mu)))
    survivors = numbered(scored.filter("passed_hard_filter"), [F.desc("z_l1"), F.asc("doc_id")], "rank_l1")
    others = scored.filter(F.coalesce(~F.col("passed_hard_filter"), F.lit(True))).withColumn("rank_l1", F.lit(None).cast("bigint"))
    return survivors.unionByName(others)


def prototype_l2() -> Column:
    out = F.col("z_l1")
    for k, w in L2_WEIGHTS.items():
        out = out + w * F.coalesce(F.col(k), F.lit(0.0))
    return F.round(out, 9)


def rank_l2(df: DataFrame, k: int, m: float, mode: str = "prototype", score: Column | None = None) -> DataFrame:
    """Adds ``score_l2, rank_l2, in_top_k``. The second stage sees the best m*k rows, ranked without a window over all of them."""
    if mode == "disabled":
        return df.withColumns({"rank_l2": F.lit(None).cast("bigint"), "score_l2": F.lit(None).cast("double"), "in_top_k": F.coalesce(F.col("rank_l1") <= k, F.lit(False))})
    chosen = F.coalesce(F.col("rank_l1") <= int(m * k), F.lit(False))
    scored = df.withColumn("score_l2", F.when(chosen, prototype_l2() if score is None else score))
    best = numbered(scored.filter(chosen), [F.desc("score_l2"), F.asc("doc_id")], "rank_l2")
    rest = scored.filter(~chosen).withColumn("rank_l2", F.lit(None).cast("bigint"))
    return best.unionByName(rest).withColumn("in_top_k", F.coalesce(F.col("rank_l2") <= k, F.lit(False)))


def finalize(df: DataFrame, include_filtered: bool = True) -> DataFrame:
    """The nine output columns, missing ones null, sorted for output."""
    kinds = {"doc_id": "string", "passed_hard_filter": "boolean", "in_top_k": "boolean", "rank_l1": "bigint", "rank_l2": "bigint"}
    out = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds.get(c, "double")).alias(c) for c in OUTPUT])
    if not include_filtered:
        out = out.filter("passed_hard_filter")
    return out.orderBy(F.desc("in_top_k"), F.asc_nulls_last("rank_l2"), F.asc_nulls_last("rank_l1"), "doc_id")


def report(df: DataFrame) -> DataFrame:
    """One row: rows, survivors, rows in the top k."""
    return df.agg(F.count("*").alias("rows"), F.count_if("passed_hard_filter").alias("passed"), F.count_if("in_top_k").alias("top_k"))


def head_and_tail(df: DataFrame, score: str, key: str, n: int = 10) -> DataFrame:
    """The ``n`` rows with the highest and the ``n`` with the lowest score, with ``end`` (head or tail); ties by ``key``. Two top-n reads."""
    head = df.orderBy(F.desc_nulls_last(score), key).limit(n).withColumn("end", F.lit("head"))
    tail = df.orderBy(F.asc_nulls_last(score), F.desc(key)).limit(n).withColumn("end", F.lit("tail"))
    return head.unionByName(tail)


def lexicographic(df: DataFrame, columns: list[str], name: str = "score") -> DataFrame:
    """Score n - position of a descending sort by several columns, nulls last; the last column breaks ties."""
    keys = [F.desc_nulls_last(c) for c in columns]
    n = df.count()
    return numbered(df, keys, "_position").withColumn(name, F.lit(n) - F.col("_position") + 1).drop("_position")
