"""Sinks: rankings, previews, projections, models, logs, reports, upserts and inspection pages."""

from __future__ import annotations

import html
import json
import math
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siktverk.functions.ids import bare_id


def write_json(payload: Any, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(payload, indent=2, sort_keys=True, ensure_ascii=False, default=str), encoding="utf-8")


def read_json(path: str) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_ranking(df: DataFrame, path: str, kind: str = "parquet", report: dict[str, Any] | None = None) -> None:
    """Parquet or NDJSON, and ``<path>.report.json``."""
    if kind not in ("parquet", "ndjson"):
        raise ValueError(f"no such format: {kind}")
    writer = df.write.mode("overwrite")
    writer.parquet(path) if kind == "parquet" else writer.json(path)
    if report is not None:
        write_json(report, f"{path}.report.json")


def preview(df: DataFrame, k: int) -> str:
    """The top k rows as a JSON array."""
    return "[" + ",".join(df.filter("in_top_k").orderBy("rank_l2", "rank_l1").limit(k).toJSON().collect()) + "]"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_once(df: DataFrame, path: str) -> None:
    """Does nothing if the output exists. All writes go through Spark's commit protocol, so no partial output is seen."""
    df.write.mode("ignore").parquet(path)


AXES = ("doc_id", "educational_value", "content_quality", "quality_score")


def score_outputs(scores: DataFrame, manifest: DataFrame, combined_columns: list[str]) -> dict[str, DataFrame]:
    """The deliverable (id, score), the axes, and the combined table; documents without scores stay, with nulls."""
    score = scores.select(F.col("doc_id").alias("_doc"), F.col("quality_score").alias("_score"))
    base = manifest.drop("quality_score").join(score, F.col("doc_id") == F.col("_doc"), "left").withColumn("quality_score", F.col("_score"))
    if "id" not in base.columns:
        base = base.withColumn("id", F.col("doc_id"))
    combined = base.select(*[F.col(c) if c in base.columns else F.lit(None).cast("string").alias(c) for c in combined_columns])
    return {"deliverable": scores.select(F.col("doc_id").alias("id"), "quality_score"), "axes": scores.select(*AXES), "combined": combined}


def manifest(df: DataFrame, first: list[str]) -> DataFrame:
    """Priority columns first, then all others."""
    return df.select(*[c for c in first if c in df.columns], *[c for c in df.columns if c not in first])


def append_failures(df: DataFrame, path: str, id_column: str = "doc_id", reason: str = "reason", run: str | None = None) -> None:
    """Appends ``id<TAB>reason`` lines, after a header line with the name and time of the run if it is given."""
    if run is not None:
        header = f"# run {run} {datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}"
        df.sparkSession.createDataFrame([(header,)], "value string").write.mode("append").text(path)
    df.select(F.concat_ws("\t", id_column, reason).alias("value")).write.mode("append").text(path)


def upsert(current: DataFrame, new: DataFrame, keys: list[str], replace: bool = False) -> DataFrame:
    """Insert-or-ignore by key, or with ``replace`` insert-or-update; repeated new rows count once."""
    new = new.dropDuplicates(keys)
    if replace:
        return current.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)
    return current.unionByName(new.join(current.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def percentage(part: float | None, whole: float | None) -> str:
    """Share in percent with one digit, ``n/a`` without a whole."""
    return "n/a" if not whole or part is None else f"{100 * part / whole:.1f}%"


def number(x: float | None) -> str:
    return "n/a" if x is None or math.isnan(x) else f"{x:.3f}"


def metrics_markdown(methods: list[dict[str, Any]], dataset: dict[str, Any], weights: dict[str, float] | None = None) -> str:
    """Report of an evaluation: data set, results to three digits, weights by size."""
    keys = [k for k in methods[0] if k != "method"] if methods else []
    out = [f"# Evaluation ({datetime.now(UTC):%Y-%m-%d})", "", "## Data set", "", *[f"- {k}: {number(v) if isinstance(v, float) else v}" for k, v in dataset.items()], "", "## Results", ""]
    out += ["| method | " + " | ".join(keys) + " |", "|" + "---|" * (len(keys) + 1)]
    out += ["| " + " | ".join([m["method"], *[str(m[k]) if isinstance(m[k], int) else number(m[k]) for k in keys]]) + " |" for m in methods]
    if weights:
        out += ["", "## Weights", "", "| feature | weight |", "|---|---|", *[f"| {k} | {v:.3f} |" for k, v in sorted(weights.items(), key=lambda x: -abs(x[1]))]]
    return "\n".join(out) + "\n"


def inspection_html(df: DataFrame, group: str, title: str, fields: list[str], per_group: int = 25, order: str | None = None) -> str:
    """Cards of up to ``per_group`` documents a group, for reading by eye."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(order) if order else bare_id("id"))
    rows = df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= per_group).orderBy(group, "_k").collect()
    cards, last = [], object()
    for r in rows:
        if r[group] != last:
            last = r[group]
            cards.append(f"<h2>{html.escape(str(last))}</h2>")
        cards.append("<article>" + "".join(f"<p><b>{html.escape(f)}</b> {html.escape(str(r[f]))}</p>" for f in fields) + "</article>")
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>" + "\n".join(cards)
