"""Ranking metrics and statistics. Names tell which of the usual variants is meant.

Tables of scores to be compared have ``method, doc_id, score, gold``; ranks are made by range partitioning, not by windows over all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siktverk.operators.ordering import numbered, numbered_within, quantiles, running_counts
from siktverk.sources.durable import durable


def relevance_bin(c: Column | str, bins: int = 8) -> Column:
    """min(floor(clip(y) * bins), bins - 1); null stays null."""
    y = F.col(c) if isinstance(c, str) else c
    return F.when(y.isNotNull(), F.least(F.floor(F.greatest(F.least(y, F.lit(1.0)), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("bigint"))


def with_ranks(df: DataFrame) -> DataFrame:
    """Adds 1-based ordinal ranks ``rp`` (score) and ``rg`` (gold) per method, ties by ``doc_id``, without a window over all rows."""
    ranked = numbered_within(df, "method", [F.desc("score"), F.asc("doc_id")], "rp")
    return numbered_within(ranked, "method", [F.desc("gold"), F.asc("doc_id")], "rg")


def guarded_corr(x: str, y: str) -> Column:
    """Pearson correlation of rows with both values; null where either side is constant (``corr`` would raise)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = (F.when(both, F.col(c).cast("double")) for c in (x, y))
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def bundle(df: DataFrame, percentiles: tuple[float, ...] = (1, 5, 10, 20, 30), ks: tuple[int, ...] = (10, 25, 50, 100)) -> DataFrame:
    """One row a method: ``n``, ``spearman`` of ordinal ranks, ``recall_p``, ``ndcg_k`` (null for k > n), gains 2^bin - 1."""
    both = df.filter("score is not null and gold is not null")
    sizes = F.broadcast(both.groupBy("method").agg(F.count("*").alias("n")))  # a row a method
    r = with_ranks(both).join(sizes, "method").withColumn("rel", relevance_bin("gold"))
    gain = F.pow(F.lit(2.0), F.col("rel")) - 1
    aggs = [F.max("n").alias("n"), guarded_corr("rp", "rg").alias("spearman")]
    for p in percentiles:
        cut = F.greatest(F.lit(1), F.ceil(F.col("n") * p / 100))
        aggs.append((F.count_if((F.col("rp") <= cut) & (F.col("rg") <= cut)) / F.max(cut)).alias(f"recall_{p:g}"))
    for k in ks:
        dcg = F.sum(F.when(F.col("rp") <= k, gain / F.log2(F.col("rp") + 1)))
        ideal = F.sum(F.when(F.col("rg") <= k, gain / F.log2(F.col("rg") + 1)))
        aggs.append(F.when(F.max("n") >= k, F.when(ideal > 0, dcg / ideal).otherwise(0.0)).alias(f"ndcg_{k}"))
    return r.groupBy("method").agg(*aggs)


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, min, max, mean, population standard deviation and linear quartiles."""
    ends = df.agg(F.count(column).alias("count"), F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
    middle = quantiles(df.select(F.lit("all").alias("g"), column), "g", column, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return ends.crossJoin(middle.agg(*[F.max(q).alias(q) for q in ("q25", "q50", "q75")]))  # one row each


def bin_histogram(df: DataFrame, column: str, bins: int = 8) -> DataFrame:
    counts = df.groupBy(relevance_bin(column, bins).alias("bin")).agg(F.count("*").alias("n")).filter("bin is not null")
    return df.sparkSession.range(bins).select(F.col("id").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the average rank of ``column`` (ties share the mean position), from its value histogram with distributed running counts."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.lit("all").alias("_g"), column).agg(F.count("*").alias("_n"))
    ranks = running_counts(counts, "_g", column, "_n").select(column, (F.col("before") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, column, "left")


def spearman_average(df: DataFrame, x: str, y: str) -> DataFrame:
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    return average_ranks(average_ranks(both, x, "_rx"), y, "_ry").agg(guarded_corr("_rx", "_ry").alias("spearman"))


#: Bits of a digit in the count of ordered pairs, and rows that are compared with each other at a time.
_DIGIT, _BLOCK = 10, 512


def _rising(digits: np.ndarray, n: np.ndarray, held: np.ndarray) -> int:
    """Weighted pairs of rows, the first of them before the second or in the histogram ``held``, whose digits rise; adds the rows to ``held``."""
    got = 0
    for k in range(0, len(digits), _BLOCK):
        d, w = digits[k : k + _BLOCK], n[k : k + _BLOCK]
        below = np.concatenate([[0], np.cumsum(held)[:-1]])
        inside = np.triu(d[:, None] < d[None, :], 1)
        got += int((below[d] * w).sum()) + int(((inside * w[:, None]).sum(axis=0) * w).sum())
        held += np.bincount(d, w, len(held)).astype(np.int64)
    return got


def _digit_pairs(cells: DataFrame, shift: int) -> int:
    """Pairs of rows, the first before the second by (x, y), whose y agree above ``shift + _DIGIT`` bits and rise in the digit there.

    Rows are range-partitioned by (prefix, x, y). Each task sends the digit histograms of its first and last prefix to the driver,
    8 KB each, and is given back what stands before its first row; only a prefix can reach beyond a partition.
    """
    spark = cells.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    prefix = F.shiftright("y", shift + _DIGIT)
    rows = cells.select(prefix.alias("p"), "x", "y", F.shiftright("y", shift).bitwiseAND((1 << _DIGIT) - 1).cast("int").alias("d"), "n")
    ranged = durable(rows.repartitionByRange(parts, "p", "x", "y").sortWithinPartitions("p", "x", "y").withColumn("part", F.spark_partition_id()).select("part", "p", "d", "n"))

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = part = None
        a, b = np.zeros(1 << _DIGIT, dtype=np.int64), np.zeros(1 << _DIGIT, dtype=np.int64)
        for batch in batches:
            p, d, n = (batch.column(k).to_numpy() for k in (1, 2, 3))
            if not len(p):
                continue
            if part is None:
                part, first = batch.column(0)[0].as_py(), p[0]
            a += np.bincount(d[p == first], n[p == first], len(a)).astype(np.int64)
            if p[-1] != last:
                last, b = p[-1], np.zeros_like(b)
            b += np.bincount(d[p == last], n[p == last], len(b)).astype(np.int64)
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "first": pa.array([first], pa.int64()), "last": pa.array([last], pa.int64()), "a": pa.array([a.tobytes()], pa.binary()), "b": pa.array([b.tobytes()], pa.binary())})

    before: dict[int, tuple[int, np.ndarray]] = {}
    open_, held = None, np.zeros(1 << _DIGIT, dtype=np.int64)
    for r in sorted(ranged.mapInArrow(ends, "part int, first bigint, last bigint, a binary, b binary").collect(), key=lambda r: r["part"]):
        if open_ == r["first"]:
            before[r["part"]] = (r["first"], held.copy())
        if r["first"] == r["last"]:
            held = (held if open_ == r["first"] else 0) + np.frombuffer(r["a"], dtype=np.int64)
        else:
            held = np.frombuffer(r["b"], dtype=np.int64).copy()
        open_ = r["last"]
    given = spark.sparkContext.broadcast(before)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, open_, held = 0, None, np.zeros(1 << _DIGIT, dtype=np.int64)
        started = False
        for batch in batches:
            p, d, n = (batch.column(k).to_numpy() for k in (1, 2, 3))
            if not len(p):
                continue
            if not started:
                started = True
                open_, held = given.value.get(batch.column(0)[0].as_py(), (p[0], held))
                held = held.copy()
            edges = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1], [True]]))
            for lo, hi in zip(edges[:-1], edges[1:]):
                if p[lo] != open_:
                    open_, held = p[lo], np.zeros_like(held)
                got += _rising(d[lo:hi], n[lo:hi].astype(np.int64), held)
        yield pa.RecordBatch.from_pydict({"n": pa.array([str(got)], pa.string())})

    return sum(int(r["n"]) for r in ranged.mapInArrow(count, "n string").collect())


def kendall_b(df: DataFrame, x: str, y: str) -> DataFrame:
    """``n, concordant, discordant, ties_x, ties_y, tau_b, p_value`` of rows with both values; the p-value is two-sided, by the normal approximation.

    Pairs that rise together are counted without being formed: values of y are replaced by ranks, and for each digit of the ranks
    rows of equal higher digits are taken in the order of x with a running histogram of the digit. A pair counts at the one digit
    where its ranks part. Equal rows are one cell with a count.
    """
    cells = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("v")).agg(F.count("*").alias("n"))
    values = cells.groupBy(F.lit("all").alias("g"), "v").agg(F.sum("n").alias("m"))
    ranks = running_counts(values, "g", "v", "m").select("v", F.col("before").alias("y"))
    held = durable(cells.join(ranks, "v").select("x", "y", "n"))
    total = int(held.agg(F.sum("n")).first()[0] or 0)
    rising = sum(_digit_pairs(held, s) for s in range(0, max(1, total).bit_length(), _DIGIT)) if total > 1 else 0

    def ties(*keys: str) -> tuple[int, int, int]:
        n = F.col("n").cast("decimal(20,0)")
        r = held.groupBy(*keys).agg(F.sum("n").alias("n")).agg(F.sum(n * (n - 1)).alias("a"), F.sum(n.cast("double") * (F.col("n") - 1) * (F.col("n") - 2)).alias("b"), F.sum(n.cast("double") * (F.col("n") - 1) * (2 * F.col("n") + 5)).alias("c")).first()
        return int(r["a"] or 0) // 2, float(r["b"] or 0), float(r["c"] or 0)

    (tx, bx, cx), (ty, by, cy), (both, _, _) = ties("x"), ties("y"), ties("x", "y")
    pairs = total * (total - 1) // 2
    concordant = rising - (tx - both)  # pairs of equal x stand in the order of y
    discordant = pairs - tx - ty + both - concordant
    scale = math.sqrt(float(pairs - tx) * float(pairs - ty))
    tau = (concordant - discordant) / scale if scale else None
    p = None
    if tau is not None:
        m = float(total) * (total - 1)
        variance = (m * (2 * total + 5) - cx - cy) / 18 + 4.0 * tx * ty / (2 * m) + (bx * by / (9 * m * (total - 2)) if total > 2 else 0)
        p = math.erfc(abs(concordant - discordant) / math.sqrt(2 * variance)) if variance > 0 else None
    return df.sparkSession.createDataFrame([(total, float(concordant), float(discordant), float(tx), float(ty), tau, p)], "n bigint, concordant double, discordant double, ties_x double, ties_y double, tau_b double, p_value double")


def student_p(r: float | None, n: int) -> float | None:
    """Two-sided p-value of a correlation ``r`` of ``n`` rows under independence, by the t distribution with n - 2 degrees of freedom."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    return _beta(1 - r * r, (n - 2) / 2, 0.5)


def _beta(x: float, a: float, b: float) -> float:
    """Regularized incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny = 1e-300
    value, c, d = tiny, tiny, 0.0
    for k in range(500):  # modified Lentz evaluation
        m = k // 2
        term = 1.0 if not k else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + term * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + term / c
        c = c if abs(c) > tiny else tiny
        value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value


def correlation_tests(df: DataFrame, x: str, y: str) -> DataFrame:
    """``method, n, statistic, p_value`` (two-sided) for Pearson, Spearman (average ranks) and Kendall's tau-b."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    n = both.count()
    pearson = both.agg(guarded_corr(x, y).alias("r")).first()["r"]
    spearman = spearman_average(both, x, y).first()["spearman"]
    tau = kendall_b(both, x, y).first()
    rows = [("pearson", n, pearson, student_p(pearson, n)), ("spearman", n, spearman, student_p(spearman, n)), ("kendall", n, tau["tau_b"], tau["p_value"])]
    return df.sparkSession.createDataFrame(rows, "method string, n bigint, statistic double, p_value double")


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, to 7 digits."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    # A polynomial fit from published tables.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    p = F.exp(-z * z / 2) / (2 * 3.141592653589793) ** 0.5 * poly
    return F.when(z >= 0, p).otherwise(1 - p)


def mann_whitney(df: DataFrame, group: str, first: str, second: str, value: str) -> DataFrame:
    """``n1, n2, u, auc, p_greater`` of the first group against the second; normal approximation with tie correction."""
    rows = df.filter(F.col(group).isin(first, second) & F.col(value).isNotNull()).select(group, value)
    counts = rows.groupBy(F.lit("all").alias("g"), value).agg(F.count_if(F.col(group) == first).alias("a"), F.count_if(F.col(group) == second).alias("b"))
    below = running_counts(counts, "g", value, "b", "a").withColumnRenamed("before", "under").withColumn("t", F.col("a") + F.col("b"))
    s = below.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * F.col("under") + F.col("a") * F.col("b") / 2).alias("u"), F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    n = F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(F.col("u") - F.col("n1") * F.col("n2") / 2 - 0.5, sd)
    return s.select("n1", "n2", "u", F.try_divide(F.col("u"), (F.col("n1") * F.col("n2")).cast("double")).alias("auc"), _tail(z).alias("p_greater"))


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """``n, pearson, slope, intercept``."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    slope = F.when(F.min(x) < F.max(x), F.try_divide(F.covar_pop(x, y), F.var_pop(x)))
    return both.agg(F.count("*").alias("n"), guarded_corr(x, y).alias("pearson"), slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("intercept"))


def bland_altman(df: DataFrame, x: str, y: str) -> DataFrame:
    d = F.col(x) - F.col(y)
    s = df.agg(F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd"))
    return s.select("bias", "sd", (F.col("bias") - 1.96 * F.col("sd")).alias("low"), (F.col("bias") + 1.96 * F.col("sd")).alias("high"))


def unit_histogram(df: DataFrame, column: str, bins: int = 25) -> DataFrame:
    """Equal bins on [0, 1] (1.0 in the last), ``bin, n, density``; empty bins are left out."""
    inside = df.filter(F.col(column).between(0, 1))
    b = F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("bigint")
    counts = inside.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("density", F.col("n") * bins / F.sum("n").over(Window.partitionBy()))


def topk_overlap(df: DataFrame, x: str, y: str, share: float = 0.1, key: str = "doc_id") -> DataFrame:
    """``n, k, top_overlap, top_jaccard, bottom_overlap, bottom_jaccard`` of the k = max(1, share n) best and worst by x and y.

    k grows with the rows, so both ends are cut by distributed positions, not by a limit.
    """
    both = durable(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, x, y))
    n = both.count()
    k = max(1, int(share * n))

    def picked(c: str, down: bool) -> DataFrame:
        return numbered(both.select(key, c), [F.desc(c) if down else F.asc(c), F.asc(key)], "_at").filter(F.col("_at") <= k).select(key)

    def shared(down: bool) -> DataFrame:
        return picked(x, down).join(picked(y, down), key).agg(F.count("*").alias("s"))

    row = shared(True).withColumnRenamed("s", "t").crossJoin(shared(False))  # one row each
    j = lambda c: F.col(c) / (2 * k - F.col(c))
    return row.select(F.lit(n).cast("bigint").alias("n"), F.lit(k).cast("bigint").alias("k"), F.col("t").alias("top_overlap"), j("t").alias("top_jaccard"), F.col("s").alias("bottom_overlap"), j("s").alias("bottom_jaccard"))


def pool_comparison(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: ``n``, mean, median, sample standard deviation, min and max of the value; nulls are left out."""
    rows = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).select(group, value)
    ends = rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return ends.join(quantiles(rows, group, value, {"median": 0.5}), group).select(group, "n", "mean", "median", "std", "min", "max")


def latin_share(c: Column | str) -> Column:
    """Share of Latin among the letters of a text; null without letters."""
    text = F.col(c) if isinstance(c, str) else c
    return F.try_divide(F.length(F.regexp_replace(text, r"[^\p{IsLatin}]", "")), F.length(F.regexp_replace(text, r"[^\p{L}]", "")))
