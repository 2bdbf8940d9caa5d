"""One ranking from several scores on unlike scales (problem 1).

Method: each score is replaced by its average rank over all documents; a distributed correlation matrix of the ranks gives
a first principal component, whose signs are turned to the declared directions; documents are sorted by their projection.

Scores that are not correlated have no first component to speak of: its loadings, signs included, are sampling noise, and a
score with a small loading would not count. So Bartlett's test asks first whether the correlations differ from none at all. If
they do, the component is that of the matrix as it is. If not, it is that of the equicorrelation estimate (all correlations,
turned to the declared directions, replaced by their mean, at least ``FLOOR``), whose loadings are equal.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siktverk.functions.ids import bare_id
from siktverk.operators.ordering import numbered, running_counts

#: Least mean correlation of the equicorrelation estimate, so that its first component is the common one.
FLOOR = 0.01
#: Correlations are taken for none if they would be as large by chance with this probability.
CHANCE = 1e-3


@dataclass(frozen=True)
class Component:
    """Correlations of the ranks, the first component as found and as used, the share of variance of the one used, and Bartlett's p-value."""

    correlations: np.ndarray
    found: np.ndarray
    used: np.ndarray
    share: float
    chance: float


def chi_tail(x: float, degrees: int) -> float:
    """Upper tail of the chi-squared distribution with a whole number of degrees of freedom, by the recurrence of the gamma function."""
    h = max(x, 0.0) / 2
    a, q = (1.0, math.exp(-h)) if degrees % 2 == 0 else (0.5, math.erfc(math.sqrt(h)))
    while a < degrees / 2 - 1e-9:
        q += math.exp(a * math.log(h) - h - math.lgamma(a + 1)) if h else 0.0
        a += 1
    return min(1.0, q)


def sphericity(correlations: np.ndarray, n: float) -> float:
    """Bartlett's test: the chance of correlations as large as these between ``n`` rows of unrelated scores."""
    p = len(correlations)
    sign, log = np.linalg.slogdet(correlations)
    if p < 2 or n <= p + 2:
        return 1.0
    return 0.0 if sign <= 0 else chi_tail(-(n - 1 - (2 * p + 5) / 6) * log, p * (p - 1) // 2)


def documents(df: DataFrame, id_column: str, scores: dict[str, str]) -> DataFrame:
    """One row a document (bare id): the largest non-null value of each score; NaN counts as null, null ids are dropped."""
    read = {k: F.expr(v).cast("double") for k, v in scores.items()}
    slim = df.select(bare_id(id_column).alias("doc_id"), *[F.when(~F.isnan(c), c).alias(k) for k, c in read.items()])
    return slim.filter("doc_id is not null").groupBy("doc_id").agg(*[F.max(k).alias(k) for k in scores])


def rank_scores(docs: DataFrame, scores: list[str]) -> DataFrame:
    """``doc_id`` and, for each score, its average rank scaled to (0, 1), null where the score is null."""
    values = docs.select("doc_id", F.inline(F.array(*[F.struct(F.lit(k).alias("score"), F.col(k).alias("value")) for k in scores])))
    values = values.filter("value is not null")
    counts = values.groupBy("score", "value").agg(F.count("*").alias("n"))
    ranks = running_counts(counts, "score", "value", "n").select("score", "value", ((F.col("before") + (F.col("n") + 1) / 2) / (F.col("total") + 1)).alias("u"))
    joined = values.join(ranks, ["score", "value"]).groupBy("doc_id").agg(*[F.max(F.when(F.col("score") == k, F.col("u"))).alias(k) for k in scores])
    return docs.select("doc_id").join(joined, "doc_id", "left")


def first_component(ranks: DataFrame, directions: dict[str, int], equal: bool | None = None) -> Component:
    """First component of the rank correlations; one row of sums reaches the driver.

    ``equal`` asks for equal loadings or for those of the matrix; without it, Bartlett's test decides.
    """
    names = list(directions)
    sums = []
    for i, a in enumerate(names):
        for b in names[: i + 1]:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            x, y = F.when(both, F.col(a) - 0.5), F.when(both, F.col(b) - 0.5)
            sums += [F.count(x), F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y)]
    got = iter([float(v or 0) for v in ranks.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()])
    m = np.eye(len(names))
    least = math.inf  # rows of the pair of scores with the fewest
    for i in range(len(names)):
        for j in range(i + 1):
            n, sx, sy, xx, yy, xy = (next(got) for _ in range(6))
            n = max(n, 1.0)
            least = min(least, n) if i != j else least
            spread = (xx - sx * sx / n) * (yy - sy * sy / n)
            if i != j:
                m[i, j] = m[j, i] = (xy - sx * sy / n) / spread**0.5 if spread > 1e-18 else 0.0
    signs = np.array([1.0 if directions[k] >= 0 else -1.0 for k in names])

    def leading(a: np.ndarray) -> tuple[np.ndarray, float]:
        values, vectors = np.linalg.eigh(a)
        v = vectors[:, -1]
        return v * (1.0 if v @ signs >= 0 else -1.0), float(values[-1] / len(names))

    found, share = leading(m)
    used, chance = found, sphericity(m, least)
    if len(names) > 1 and (chance > CHANCE if equal is None else equal):
        turned = m * np.outer(signs, signs)
        mean = max(FLOOR, (turned.sum() - len(names)) / (len(names) * (len(names) - 1)))
        used, share = leading(((1 - mean) * np.eye(len(names)) + mean) * np.outer(signs, signs))
    return Component(m, found, np.where(np.sign(used) == signs, used, signs * np.abs(used)), share, chance)


def fuse(df: DataFrame, id_column: str, scores: dict[str, str], directions: dict[str, int], equal: bool | None = None) -> tuple[DataFrame, Component]:
    """``doc_id, projection, missing, position`` for every document, best first, and the component used.

    A null score counts as the middle rank and is told in ``missing``; tied projections share their order by ``doc_id``;
    repeated rows of a document count once; an empty table gives an empty ranking. Other columns are ignored.
    """
    names = list(scores)
    ranks = rank_scores(documents(df, id_column, scores), names)
    component = first_component(ranks, {k: directions[k] for k in names}, equal)
    terms = [F.coalesce(F.col(k) - 0.5, F.lit(0.0)) * float(w) for k, w in zip(names, component.used)]
    missing = sum((F.col(k).isNull().cast("int") for k in names), F.lit(0))
    scored = ranks.select("doc_id", F.round(sum(terms, F.lit(0.0)), 12).alias("projection"), missing.alias("missing"))
    return numbered(scored, [F.desc("projection"), F.asc("doc_id")]), component
