"""Learned rankers: pairwise linear (grid search, one Spark task a cell), boosted trees with pairwise lambda gradients, baselines.

Fits see at most ``MAX_ROWS`` labelled rows, those with the smallest id hashes; scoring is columnar or Arrow-batched and covers all.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from siktverk.functions.ids import canonical_id, hash_key, hash_split
from siktverk.operators.features import FEATURES, Stats, matrix_columns
from siktverk.operators.metrics import relevance_bin
from siktverk.operators.ranking import Linear, lexicographic

MAX_ROWS = 20_000


def label_pairs(y: np.ndarray, most: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Winner and loser positions of pairs with different labels: all, or a seeded draw of ``most``."""
    n = len(y)
    r = np.random.default_rng(seed)
    if n * (n - 1) // 2 <= most:
        i, j = np.triu_indices(n, 1)
    else:
        i, j = r.integers(0, n, 2 * most), r.integers(0, n, 2 * most)
    keep = y[i] != y[j]
    i, j = i[keep][:most], j[keep][:most]
    up = y[i] > y[j]
    return np.where(up, i, j), np.where(up, j, i)


def fit_linear(x: np.ndarray, y: np.ndarray, alpha: float, gamma: float, rate: float = 0.05, epochs: int = 250, most: int = 250_000, seed: int = 42) -> np.ndarray:
    """Weights by gradient descent on the logistic loss of winner - loser differences, weighted by 1 + gamma dy."""
    w = np.zeros(x.shape[1])
    a, b = label_pairs(y, most, seed)
    if not len(a):
        return w
    d = x[a] - x[b]
    weight = 1 + gamma * (y[a] - y[b])
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -35, 35)))
        w -= rate / len(a) * (alpha * w + d.T @ (weight * (p - 1)))
    return w


def recall(score: np.ndarray, y: np.ndarray, percent: float) -> float:
    n = len(y)
    if not n:
        return 0.0
    k = max(1, int(np.ceil(n * percent / 100)))
    return len(set(np.argsort(-score, kind="stable")[:k]) & set(np.argsort(-y, kind="stable")[:k])) / k


def labelled_sample(df: DataFrame) -> pd.DataFrame:
    """``doc_id, split, gold_score`` and the scaled features (null as 0) of at most MAX_ROWS labelled survivors."""
    columns = [F.coalesce(F.col(f"{f}_z"), F.lit(0.0)).alias(f) for f in FEATURES]
    rows = df.filter("gold_score is not null and passed_hard_filter").select("doc_id", hash_split(canonical_id("doc_id")).alias("split"), "gold_score", *columns)
    return rows.orderBy(hash_key("doc_id"), "doc_id").limit(MAX_ROWS).toPandas().sort_values("doc_id", ignore_index=True)


@dataclass
class LinearFit:
    model: Linear
    alpha: float
    gamma: float
    recall: dict[str, float]
    stats: Stats | None = None

    def to_dict(self) -> dict:
        return asdict(self)


def grid_search(df: DataFrame, alphas: tuple[float, ...], gammas: tuple[float, ...], percentiles: tuple[float, ...] = (1, 5, 10, 20, 30), rate: float = 0.05, epochs: int = 250, most: int = 250_000, stats: Stats | None = None) -> tuple[LinearFit, pd.DataFrame]:
    """Best cell by mean validation recall, the first wins ties; and all cells. Each cell is one task of a Spark job."""
    spark = df.sparkSession
    data = labelled_sample(df)
    held = spark.sparkContext.broadcast((data[list(FEATURES)].to_numpy(), data["gold_score"].to_numpy(), data["split"].to_numpy()))
    cells = spark.createDataFrame([(k, float(a), float(g)) for k, (a, g) in enumerate((a, g) for a in alphas for g in gammas)], "cell int, alpha double, gamma double")

    def fit(batch: pd.DataFrame) -> pd.DataFrame:
        x, y, split = held.value
        train, val = split == "train", split == "val"
        out = []
        for c in batch.itertuples():
            w = fit_linear(x[train], y[train], c.alpha, c.gamma, rate, epochs, most)
            got = [recall(x[val] @ w, y[val], p) for p in percentiles]
            out.append((c.cell, c.alpha, c.gamma, float(np.mean(got)) if got else 0.0, [float(g) for g in got], w.tolist()))
        return pd.DataFrame(out, columns=["cell", "alpha", "gamma", "mean_recall", "recall", "weights"])

    schema = "cell int, alpha double, gamma double, mean_recall double, recall array<double>, weights array<double>"
    fitted = cells.groupBy("cell").applyInPandas(fit, schema).toPandas().sort_values("cell", ignore_index=True)
    best = fitted.loc[fitted["mean_recall"].idxmax()]
    model = Linear(dict(zip(FEATURES, map(float, best["weights"]))))
    return LinearFit(model, best["alpha"], best["gamma"], {f"{p:g}": r for p, r in zip(percentiles, best["recall"])}, stats), fitted


class Lambda:
    """LambdaRank: regression trees of depth 4 (up to 16 leaves) on lambda gradients of NDCG, inside groups of rows."""

    def __init__(self, rounds: int = 200, rate: float = 0.05, depth: int = 4, ridge: float = 1.0, bins: int = 32) -> None:
        self.rounds, self.rate, self.depth, self.ridge, self.bins = rounds, rate, depth, ridge, bins
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def _lambdas(score: np.ndarray, rel: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        g, h = np.zeros(len(score)), np.zeros(len(score))
        for rows in groups:
            s, gain = score[rows], 2.0 ** rel[rows] - 1
            place = np.empty(len(rows), dtype=int)
            place[np.argsort(-s, kind="stable")] = np.arange(len(rows))
            discount = 1 / np.log2(place + 2)
            ideal = (np.sort(gain)[::-1] / np.log2(np.arange(len(rows)) + 2)).sum()
            if ideal <= 0:
                continue
            better = gain[:, None] > gain[None, :]
            delta = np.abs((gain[:, None] - gain[None, :]) * (discount[:, None] - discount[None, :])) / ideal
            p = 1 / (1 + np.exp(np.clip(s[:, None] - s[None, :], -35, 35)))
            lam, cur = np.where(better, p * delta, 0), np.where(better, p * (1 - p) * delta, 0)
            g[rows] += lam.sum(1) - lam.sum(0)
            h[rows] += cur.sum(1) + cur.sum(0)
        return g, h

    def fit(self, x: np.ndarray, rel: np.ndarray, groups: list[np.ndarray]) -> Lambda:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])] if len(x) else []
        binned = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
        score = np.zeros(len(x))
        inner = 2**self.depth - 1
        for _ in range(self.rounds):
            g, h = self._lambdas(score, rel, groups)
            feature, threshold, at = np.zeros(inner, dtype=int), np.full(inner, np.inf), np.zeros(len(x), dtype=int)
            for node in range(inner):
                rows = np.flatnonzero(at == node)
                best, where = 1e-9, (0, np.inf)
                if len(rows) >= 10:
                    whole = g[rows].sum() ** 2 / (h[rows].sum() + self.ridge)
                    for j, c in enumerate(cuts):
                        if len(c):
                            lg = np.cumsum(np.bincount(binned[j][rows], g[rows], len(c) + 1))[:-1]
                            lh = np.cumsum(np.bincount(binned[j][rows], h[rows], len(c) + 1))[:-1]
                            gain = lg**2 / (lh + self.ridge) + (g[rows].sum() - lg) ** 2 / (h[rows].sum() - lh + self.ridge) - whole
                            if gain.max() > best:
                                best, where = float(gain.max()), (j, float(c[gain.argmax()]))
                feature[node], threshold[node] = where
                at[rows] = 2 * node + 1 + (x[rows, where[0]] >= where[1])
            leaf = at - inner
            value = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.ridge)
            self.trees.append((feature, threshold, value))
            score += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, value in self.trees:
            at = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] >= threshold[at])
            out += value[at - len(feature)]
        return out


def train_lambda(df: DataFrame, groups: DataFrame, rounds: int = 200, bins: int = 8) -> Lambda:
    """Second-stage model from labelled rows of the training split, in groups ``(bucket..., group, doc_id)``.

    Groups are at most 64 rows and 32 a bucket; MAX_ROWS of their rows are used.
    """
    columns = matrix_columns()
    rows = df.filter("gold_score is not null and passed_hard_filter").filter(hash_split(canonical_id("doc_id")) == "train")
    rows = rows.select("doc_id", relevance_bin("gold_score", bins).alias("rel"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    keys = [c for c in groups.columns if c != "doc_id"]
    member = groups.select(F.xxhash64(*keys).alias("g"), "doc_id")
    data = rows.join(member, "doc_id").orderBy("g", "doc_id").limit(MAX_ROWS).toPandas()
    parts = [np.asarray(v) for v in data.groupby("g").indices.values() if len(v) > 1]
    return Lambda(rounds).fit(data[columns].to_numpy(dtype=float), data["rel"].to_numpy(dtype=float), parts)


def score_lambda(df: DataFrame, model: Lambda, name: str = "score_l2") -> DataFrame:
    """Adds the model's score, in Arrow batches."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def predict(*columns: pd.Series) -> pd.Series:
        return pd.Series(held.value.predict(np.column_stack([c.fillna(0.0).to_numpy() for c in columns])))

    return df.withColumn(name, F.round(predict(*[F.col(c).cast("double") for c in matrix_columns()]), 9))


def baselines(df: DataFrame, seed: int = 42) -> DataFrame:
    """``method, doc_id, score, gold`` of the four baselines, from ``doc_id``, features and ``gold_score``.

    Random scores are hashes of seed and id; the lexicographic ones are n - position of a sort that the id hash decides.
    """
    slim = df.withColumns({"_hash": hash_key("doc_id"), "gold": F.col("gold_score")})
    mean = sum((F.coalesce(F.col(f"{f}_z"), F.lit(0.0)) for f in FEATURES), F.lit(0.0)) / len(FEATURES)
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id")), 256), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    pick = lambda d, name: d.select(F.lit(name).alias("method"), "doc_id", F.col("score").cast("double").alias("score"), "gold")
    out = pick(slim.withColumn("score", draw), "random").unionByName(pick(slim.withColumn("score", F.round(mean, 9)), "feature_mean"))
    for name, order in (("edu_first", ["educational_value", "content_quality", "safety"]), ("quality_first", ["content_quality", "educational_value", "safety"])):
        out = out.unionByName(pick(lexicographic(slim.select("doc_id", "gold", "_hash", *order), [*order, "_hash"]), name))
    return out
