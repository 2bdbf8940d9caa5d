"""The pipelines end to end: ranking run, training of both stages, evaluation on a hash holdout or an external set."""

from __future__ import annotations

import base64
import pickle
from dataclasses import asdict
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siktverk.functions.ids import bare_id, canonical_id, hash_key, hash_split
from siktverk.operators import features, joins, judging, metrics, ranking, sampling, training
from siktverk.plans.config import Gold, Pipeline
from siktverk.sources import readers, sinks
from siktverk.sources.durable import durable


def load_l1(path: str | None) -> ranking.Linear:
    """The model of a training run, or the prototype where none is named."""
    if not path:
        return ranking.PROTOTYPE
    raw = sinks.read_json(path)["model"]
    return ranking.Linear({k: float(v) for k, v in raw["weights"].items()}, float(raw["intercept"]))


def load_l2(path: str | None) -> training.Lambda | None:
    return pickle.loads(base64.b64decode(sinks.read_json(path)["model"])) if path else None  # noqa: S301 - a file of our own training run


def joined(spark: SparkSession, config: Pipeline, annotations: DataFrame | None = None, metadata: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Annotations with metadata under bare ids; a config without metadata names a table that is joined already."""
    a = annotations if annotations is not None else readers.read_local(spark, config.annotations)
    if "id" not in a.columns and "doc_id" in a.columns:
        a = a.withColumnRenamed("doc_id", "id")
    a = a.withColumn("id", bare_id("id"))
    m = metadata if metadata is not None else readers.read_local(spark, config.metadata) if config.metadata else None
    out = a if m is None else joins.join_metadata(a, m.withColumn("id", bare_id("id")))
    return out if targets is None else joins.members(out, targets, "id", targets.columns[0])


def prepare(df: DataFrame, config: Pipeline) -> DataFrame:
    f = config.hard_filter
    return ranking.prepare(df, f.expected_lid, f.minimum, f.require_pii_absence, config.priority.unit())


def run(spark: SparkSession, config: Pipeline, annotations: DataFrame | None = None, metadata: DataFrame | None = None, write: bool = True) -> DataFrame:
    """The ranking of a configuration; written with its report, if asked for."""
    prepared = prepare(joined(spark, config, annotations, metadata), config)
    ranked = ranking.rank_l1(prepared, load_l1(config.l1_model), config.priority.unit(), config.priority.mu)
    r, model = config.ranking, load_l2(config.l2_model)
    if r.l2_mode == "trained":
        if model is None:
            raise ValueError("l2_mode is trained, but no l2_model is named")
        ranked = training.score_lambda(ranked, model, "_s")
        ranked = ranking.rank_l2(ranked, r.k, r.m, "trained", F.col("_s"))
    else:
        ranked = ranking.rank_l2(ranked, r.k, r.m, r.l2_mode)
    ranked = durable(ranked)
    out = ranking.finalize(ranked, r.include_filtered_rows)
    if write:
        sinks.write_ranking(out, r.output_path, r.output_format, ranking.report(ranked).first().asDict() | {"config": asdict(config)})
    return out


def gold(spark: SparkSession, config: Gold, scorer: judging.Scorer = judging.stub) -> dict[str, Any]:
    """A judged sample: strata, sample, texts, cost, scores, and the three output tables, all under ``config.output``.

    Each step starts from what the one before has written, so a repeated run asks for no text and no score twice. Returns the
    estimate, and the summary of the scores unless the run ended before them: with ``estimate_only``, or over the budget.
    """
    at = lambda name: f"{config.output}/{name}"
    strata = ["edu_ord", "quality_ord"]
    if config.skip_scoring:
        return {"summary": judging.summary(spark.read.parquet(at("scores"))).first().asDict()}
    sinks.write_json(asdict(config), at("config.json"))
    pool = sampling.with_strata(readers.pool_scan(readers.read_local(spark, config.annotations), config.pool_size))
    drawn = sampling.stratified_sample(pool, strata, config.size, config.mode, config.seed).withColumn("language", F.lit(config.language))
    manifest = sinks.manifest(drawn.withColumnRenamed("id", "doc_id"), ["doc_id", *strata, "stratum_weight", "language"])
    sinks.write_once(manifest, at("sample"))
    manifest = spark.read.parquet(at("sample"))
    sinks.write_csv(sampling.stratum_stats(pool, strata, config.size, config.mode), at("strata"))
    corpus = None if config.skip_text_fetch or config.corpus is None else readers.read_local(spark, config.corpus)
    if corpus is not None and config.max_scan is not None:
        corpus = corpus.limit(config.max_scan)
    ids = manifest.select(bare_id("doc_id").alias("id"))
    texts = readers.fetch_texts(corpus, ids, path=at("texts")).filter("trim(text) <> ''").withColumnRenamed("id", "doc_id")
    if texts.isEmpty():
        raise ValueError("no texts for the sample")
    template = Path(config.prompt).read_text(encoding="utf-8")
    most = 2**31 - 1 if config.max_chars < 0 else config.max_chars
    out: dict[str, Any] = {"estimate": judging.cost(texts, len(template), config.price_in, config.price_out, most).first().asDict()}
    if config.estimate_only or config.max_budget is not None and out["estimate"]["usd"] > config.max_budget:
        return out
    scores = judging.judge_to(texts, template, at("scores"), scorer, config.checkpoint_every, max_chars=most, parallel=config.batch_size)
    failed = scores.filter("quality_score is null").select("doc_id", F.lit("failed or malformed after retries").alias("reason"))
    sinks.append_failures(failed, at("failures"), run=config.output)
    keyed = manifest.withColumn("doc_id", bare_id("doc_id"))
    for name, df in sinks.score_outputs(scores, keyed, ["id", "quality_score", *[c for c in keyed.columns if c not in ("doc_id", *strata, "stratum_weight", "language")]]).items():
        df.write.mode("overwrite").parquet(at(name))
        sinks.write_csv(df, at(f"{name}_csv"))
    return out | {"summary": judging.summary(scores).first().asDict()}


def labelled(prepared: DataFrame, labels: DataFrame) -> DataFrame:
    return durable(joins.attach_labels(prepared, joins.load_labels(labels)))


def _description(rows: DataFrame) -> dict[str, Any]:
    return metrics.describe(rows, "gold_score").first().asDict() | {"bins": {str(r["bin"]): r["n"] for r in metrics.bin_histogram(rows, "gold_score").collect()}}


def train_l1(spark: SparkSession, config: Pipeline, labels: DataFrame, path: str, annotations: DataFrame | None = None, metadata: DataFrame | None = None) -> training.LinearFit:
    """Grid search on the training split, chosen on the validation split; model, statistics and report in one JSON file."""
    t = config.training
    rows = labelled(prepare(joined(spark, config, annotations, metadata), config), labels)
    stats = features.nearest_rank_stats(rows.filter("passed_hard_filter"), list(features.FEATURES))
    fit, cells = training.grid_search(rows, t.alphas, t.gammas, t.percentiles, t.learning_rate, t.epochs, t.max_pairs, stats)
    sinks.write_json(fit.to_dict() | {"cells": cells[["alpha", "gamma", "mean_recall"]].to_dict("records"), "labels": _description(rows)}, path)
    return fit


def train_l2(spark: SparkSession, config: Pipeline, labels: DataFrame, path: str, annotations: DataFrame | None = None, metadata: DataFrame | None = None, rounds: int = 200) -> training.Lambda:
    """Lambda trees on groups of the training split."""
    t = config.training
    prepared = prepare(joined(spark, config, annotations, metadata), config)
    rows = labelled(ranking.rank_l1(prepared, load_l1(config.l1_model), config.priority.unit(), config.priority.mu), labels)
    groups = sampling.training_groups(rows.filter(F.col("passed_hard_filter") & (hash_split(canonical_id("doc_id")) == "train")), ["content_type", "length"], t.group_size, t.groups_per_bucket)
    model = training.train_lambda(rows, groups, rounds, t.relevance_bins)
    sinks.write_json({"model": base64.b64encode(pickle.dumps(model)).decode(), "labels": _description(rows)}, path)
    return model


def evaluate(spark: SparkSession, config: Pipeline, labels: DataFrame, external: bool = False, annotations: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """One row of metrics a method: four baselines, the first stage, and the second stage where a model is named.

    On the hash holdout of the labels (the test split by canonical id), or on all rows of an external set. Documents count once.
    """
    prepared = prepare(joined(spark, config, annotations, metadata), config)
    model = load_l1(config.l1_model)
    unit, mu = config.priority.unit(), config.priority.mu
    rows = labelled(prepared, labels)
    rows = joins.first_per_key(rows.withColumn("_c", canonical_id("doc_id")), ["_c"], hash_key("doc_id"), "doc_id").drop("_c")
    if not external:
        rows = rows.filter(hash_split(canonical_id("doc_id")) == "test")
    rows = durable(rows.withColumn("z_l1", model.score(unit, mu)))
    scores = training.baselines(rows).unionByName(rows.select(F.lit("l1").alias("method"), "doc_id", F.col("z_l1").alias("score"), F.col("gold_score").alias("gold")))
    scores = scores.unionByName(rows.select(F.lit("l1_plain").alias("method"), "doc_id", model.score().alias("score"), F.col("gold_score").alias("gold")))
    if (l2 := load_l2(config.l2_model)) is not None:
        scored = training.score_lambda(rows, l2, "score")
        scores = scores.unionByName(scored.select(F.lit("l2").alias("method"), "doc_id", "score", F.col("gold_score").alias("gold")))
    return metrics.bundle(scores, config.training.percentiles, config.training.eval_k)


def evaluation_report(result: DataFrame, dataset: dict[str, Any], weights: dict[str, float] | None, markdown: str | None = None, as_json: str | None = None) -> str:
    rows = [r.asDict() for r in result.orderBy("method").collect()]
    text = sinks.metrics_markdown(rows, dataset, weights)
    if markdown:
        Path(markdown).write_text(text, encoding="utf-8")
    if as_json:
        sinks.write_json({"dataset": dataset, "methods": rows, "weights": weights}, as_json)
    return text
