"""A sample with given category shares (problem 3).

Method: a document's priority is a seeded hash of its id, and a category's reservoir holds its smallest priorities. Such
reservoirs merge: that of a union is the smallest of both. One pass over the documents fills them; they lie in a table by
category and leading digits of the priority, so that no task holds a whole reservoir, beside counts of the same cells, which add up.
When the final counts are known, every reservoir is trimmed to its feasible quota by a priority bound, so that each document
of a category has the same chance. Report and sample come from the same reservoirs.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siktverk.functions.ids import bare_id, seeded_order
from siktverk.sources.durable import Steps

#: Leading hexadecimal digits of the priority by which a reservoir is laid out; only documents of one cell a category are ever sorted.
DIGITS = 3


def _label(name: str) -> Column:
    return F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))


def labelled(df: DataFrame, labels: list[str], id_column: str = "id") -> DataFrame:
    """Distinct documents (bare id) with their labels in lower case without surrounding blanks; null ids are dropped."""
    return df.select(bare_id(id_column).alias("id"), *[_label(c).alias(c) for c in labels]).filter("id is not null").distinct()


def feasible(targets: list[tuple[int, int, int]], size: int) -> list[int]:
    """Rows to draw from each target (``percent, least, available``) for a sample of ``size``.

    Shares are rounded by largest remainder, raised to ``least`` and cut to what is available. What exhausted targets leave
    over is shared by the others in proportion to their percentages, as long as any has documents left.
    """

    def shared(n: int, weights: list[int]) -> list[int]:
        whole = sum(weights)
        exact = [Fraction(n * w, whole) if whole else Fraction(0) for w in weights]
        out = [int(x) for x in exact]
        order = sorted(range(len(exact)), key=lambda i: (out[i] - exact[i], i))
        for i in order[: n - sum(out)] if whole else ():
            out[i] += 1
        return out

    wanted = size * sum(p for p, _, _ in targets) // 100
    given = [min(have, max(least, q)) for (_, least, have), q in zip(targets, shared(wanted, [p for p, _, _ in targets]))]
    while (left := wanted - sum(given)) > 0:
        weights = [p if have > g else 0 for (p, _, have), g in zip(targets, given)]
        more = [min(have - g, m) for (_, _, have), g, m in zip(targets, given, shared(left, weights))]
        if not any(more):
            break
        given = [g + m for g, m in zip(given, more)]
    return given


class Sample:
    """Quotas and sample for ``targets`` (labels, ``target_pct``, ``min_rows``) out of ``share`` of all distinct documents.

    Rows whose label is null or in no target count for the sample size only. A document delivered with several label
    pairs counts in each and may be sampled for each. Targets with equal labels are merged (their shares add up). An empty
    table gives a report with nothing available. The targets are few, as a table of quotas is, and reach the driver.
    """

    def __init__(self, df: DataFrame, targets: DataFrame, labels: list[str], share: float = 0.2, seed: int = 7) -> None:
        self.labels, self.seed = labels, seed
        rows = labelled(df, labels).withColumn("priority", seeded_order("id", seed)).withColumn("cell", F.substring("priority", 1, DIGITS))
        self.reservoirs = Steps(df.sparkSession).next(rows)
        wanted = targets.groupBy(*[_label(c).alias(c) for c in labels]).agg(F.sum(F.coalesce("target_pct", F.lit(0))).alias("target_pct"), F.max(F.coalesce("min_rows", F.lit(0))).alias("min_rows"))
        self.wanted = wanted.na.drop(subset=labels)
        self.share = share

    def summaries(self) -> DataFrame:
        """Documents by category and leading digits of the priority: what tells how far a reservoir reaches."""
        return self.reservoirs.na.drop(subset=self.labels).groupBy(*self.labels, "cell").agg(F.count("*").alias("n"))

    def report(self) -> DataFrame:
        """Labels, ``target_pct, min_rows, available, required, quota, met``.

        ``required`` is the larger of ``min_rows`` and the share of the sample size, rounded up; ``met`` tells whether the
        reservoir of the category holds so many documents. ``quota`` is what is drawn, see :func:`feasible`.
        """
        spark = self.reservoirs.sparkSession
        # ids are spread over the cells by their hash, so those of a cell are counted without meeting the others
        ids = self.reservoirs.select("cell", "id").distinct().groupBy("cell").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        size = int(ids.first()["n"] * self.share + 1e-9)
        counts = self.summaries().groupBy(*self.labels).agg(F.sum("n").alias("available"))
        rows = self.wanted.join(counts, self.labels, "left").select(*self.labels, F.col("target_pct").cast("bigint"), F.col("min_rows").cast("int"), F.coalesce("available", F.lit(0)).cast("bigint").alias("available")).collect()
        rows.sort(key=lambda r: tuple(r)[: len(self.labels)])
        quotas = feasible([(r["target_pct"], r["min_rows"], r["available"]) for r in rows], size)
        out = []
        for r, quota in zip(rows, quotas):
            required = max(r["min_rows"], -(-r["target_pct"] * size // 100))
            out.append((*tuple(r), required, quota, r["available"] >= required))
        schema = ", ".join(f"{c} string" for c in self.labels) + ", target_pct bigint, min_rows int, available bigint, required bigint, quota bigint, met boolean"
        return spark.createDataFrame(out, schema)

    def draw(self) -> DataFrame:
        """``id`` and the labels of the sampled documents: each reservoir up to its quota."""
        quotas = self.report().select(*self.labels, "quota")
        w = Window.partitionBy(*self.labels).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows at most
        cut = self.summaries().join(F.broadcast(quotas), self.labels).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
        cut = cut.filter("before < quota").select(*self.labels, "cell", (F.col("quota") - F.col("before")).alias("room"), "n")
        rows = self.reservoirs.join(F.broadcast(cut), [*self.labels, "cell"])  # 4096 rows a target at most
        inside = Window.partitionBy(*self.labels, "cell").orderBy("priority", "id")
        return rows.withColumn("k", F.row_number().over(inside)).filter("k <= room").select("id", *self.labels)
