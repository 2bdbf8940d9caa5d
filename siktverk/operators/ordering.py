"""Global positions, running counts and quantiles without a single-task window.

Rows are range-partitioned by the sort key, numbered inside their partition and written once; the offset of a partition is
the number of rows before it. Only one number a partition (and group) reaches the driver, and comes back as a small table
that is looked up by hash, so plan and cost a row do not grow with the number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siktverk.sources.durable import durable

_LOW = (1 << 33) - 1


def _looked_up(df: DataFrame, key: list[str], rows: list[tuple], schema: str) -> DataFrame:
    """``df`` with the columns of a small table by ``key``; null keys match."""
    small = df.sparkSession.createDataFrame(rows, schema)
    renamed = small.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], *[c for c in small.columns if c not in key])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    return df.join(F.broadcast(renamed), same, "left").drop(*[f"_k{i}" for i in range(len(key))])  # a row a partition and group


def numbered(df: DataFrame, keys: list[Column], name: str = "position") -> DataFrame:
    """``df`` with a 1-based ``name`` by ``keys``; end the keys with a unique one for a reproducible order."""
    at = F.monotonically_increasing_id()
    kept = durable(df.orderBy(*keys).withColumn("_at", at))
    kept = kept.withColumn("_part", F.shiftright("_at", 33).cast("int"))
    totals = {r["_part"]: r["n"] for r in kept.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    rows, running = [], 0
    for k in sorted(totals):
        rows.append((k, running))
        running += totals[k]
    out = _looked_up(kept, ["_part"], rows, "_part int, _offset bigint")
    return out.withColumn(name, F.col("_offset") + F.col("_at").bitwiseAND(_LOW) + 1).drop("_at", "_part", "_offset")


def numbered_within(df: DataFrame, group: str, keys: list[Column], name: str = "position") -> DataFrame:
    """:func:`numbered` inside each group; groups are few (methods, classes), as one number a group reaches the driver."""
    kept = numbered(df, [F.asc(group), *keys], "_all")
    sizes = {r[group]: r["n"] for r in kept.groupBy(group).agg(F.count("*").alias("n")).collect()}
    rows, running = [], 0
    for k in sorted(sizes, key=lambda k: (k is not None, k)):
        rows.append((k, running))
        running += sizes[k]
    out = _looked_up(kept, [group], rows, f"{group} {dict(df.dtypes)[group]}, _start bigint")
    return out.withColumn(name, F.col("_all") - F.col("_start")).drop("_all", "_start")


def running_counts(counts: DataFrame, group: str, value: str, n: str, *keep: str) -> DataFrame:
    """``group, value, n, before, total``: rows of the group below the value, and in the group; ``counts`` has a row for each value.

    A value that holds a third of all rows is one row here. Columns named in ``keep`` stay.
    """
    parts = counts.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = counts.select(group, value, n, *keep).repartitionByRange(int(parts), group, value)
    kept = durable(ranged.withColumn("_part", F.spark_partition_id()))
    sums = kept.groupBy(group, "_part").agg(F.sum(n).alias("s")).collect()
    totals: dict = {}
    for r in sums:
        totals[r[group]] = totals.get(r[group], 0) + r["s"]
    rows, held = [], {}
    for r in sorted(sums, key=lambda r: r["_part"]):
        rows.append((r[group], r["_part"], held.get(r[group], 0), totals[r[group]]))
        held[r[group]] = held.get(r[group], 0) + r["s"]
    w = Window.partitionBy(group, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    numbered_ = kept.withColumn("_inside", F.coalesce(F.sum(n).over(w), F.lit(0)))
    out = _looked_up(numbered_, [group, "_part"], rows, f"{group} {dict(counts.dtypes)[group]}, _part int, _offset bigint, total bigint")
    return out.withColumn("before", (F.col("_inside") + F.col("_offset")).cast("bigint")).select(group, value, n, *keep, "before", "total")


def quantiles(df: DataFrame, group: str, value: str, at: dict[str, float]) -> DataFrame:
    """``group`` and, under each name in ``at``, the quantile of the group's values by linear interpolation; nulls are left out.

    From the value histogram, so that a group of any size is spread over all tasks.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    ranked = running_counts(counts, group, "_v", "_n")
    aggs = []
    for name, q in at.items():
        place = (F.col("total") - 1) * F.lit(float(q))
        low, high = F.floor(place), F.ceil(place)
        inside = lambda p: F.max(F.when((F.col("before") <= p) & (p < F.col("before") + F.col("_n")), F.col("_v")))
        part = F.max(place - low)
        aggs.append((inside(low) + (inside(high) - inside(low)) * part).alias(name))
    return ranked.groupBy(group).agg(*aggs)
