from __future__ import annotations

import pytest

import __spark_entry__
from siktverk import cli
from siktverk.plans import pipeline, views
from siktverk.plans.config import Gold, HardFilter, Pipeline, Ranking
from siktverk.sources import sinks
from siktverk.sources.tables import table


def test_run_train_evaluate(spark, small, tmp_path):
    ann, meta = views.annotations(spark, small), views.metadata(spark, small)
    labels = table(spark, small, "l1_pairwise", "doc_id", "gold_score")
    config = Pipeline(hard_filter=HardFilter(expected_lid=None), ranking=Ranking(k=5, m=2, output_path=f"{tmp_path}/r"))
    config.training.epochs, config.training.alphas, config.training.gammas = 20, (0.01, 1.0), (0.0, 1.0)
    assert pipeline.run(spark, config, ann, meta).filter("in_top_k").count() == 5
    assert sinks.read_json(f"{tmp_path}/r.report.json")["top_k"] == 5
    fit = pipeline.train_l1(spark, config, labels, f"{tmp_path}/l1.json", ann, meta)
    config.l1_model = f"{tmp_path}/l1.json"
    assert pipeline.load_l1(config.l1_model).weights == fit.model.weights
    pipeline.train_l2(spark, config, labels, f"{tmp_path}/l2.json", ann, meta, rounds=5)
    config.l2_model, config.ranking.l2_mode = f"{tmp_path}/l2.json", "trained"
    assert pipeline.run(spark, config, ann, meta, write=False).filter("rank_l2 is not null").count() == 10
    result = pipeline.evaluate(spark, config, labels, True, ann, meta)
    assert {r["method"] for r in result.collect()} == {"random", "feature_mean", "edu_first", "quality_first", "l1", "l1_plain", "l2"}
    assert "| l2 |" in pipeline.evaluation_report(result, {"rows": 1}, fit.model.weights, f"{tmp_path}/e.md", f"{tmp_path}/e.json")


def test_cli_config(tmp_path):
    path = f"{tmp_path}/c.yaml"
    assert cli.main(["new-config", path, "--k", "7"]) == 0
    assert pipeline.Pipeline and cli.load_config(path).ranking.k == 7
    with pytest.raises(SystemExit):
        cli.main(["odd"])


def test_entry(spark, small):
    assert __spark_entry__.entry(spark).count() > 0
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60


def test_gold(spark, tmp_path):
    labels = ["none", "minimal", "basic", "moderate", "high"]
    rows = [(f"<urn:uuid:D{i}>", labels[i % 5], ["poor", "good"][i % 2], "report") for i in range(60)]
    spark.createDataFrame(rows, "id string, educational_value string, content_quality string, content_type string").write.parquet(f"{tmp_path}/a.parquet")
    spark.createDataFrame([(f"d{i}", f"text {i}" if i % 7 else " ") for i in range(60)], "id string, text string").write.parquet(f"{tmp_path}/t.parquet")
    (tmp_path / "prompt.txt").write_text("Rate {id}: {text}")
    args = ["gold", "--annotations", f"{tmp_path}/a.parquet", "--corpus", f"{tmp_path}/t.parquet", "--output", f"{tmp_path}/out", "--prompt", f"{tmp_path}/prompt.txt", "--size", "20"]
    parsed = vars(cli.parser().parse_args([*args, "--max-budget", "0.5"]))
    config = Gold(**{k: v for k, v in parsed.items() if k not in ("command", "scorer")})
    assert config.size == 20 and config.max_budget == 0.5 and not config.skip_scoring
    out = pipeline.gold(spark, config)
    held = spark.read.parquet(f"{tmp_path}/out/deliverable").collect()
    assert out["summary"]["n"] == len(held) == out["estimate"]["documents"] and out["summary"]["failed"] == 0
    assert spark.read.parquet(f"{tmp_path}/out/sample").count() == 20 and spark.read.parquet(f"{tmp_path}/out/combined").count() == 20
    assert pipeline.gold(spark, config)["summary"]["n"] == len(held)  # nothing is asked for twice
    config.max_budget = 0.0
    assert "summary" not in pipeline.gold(spark, config)
    config.skip_scoring = True
    assert pipeline.gold(spark, config)["summary"]["n"] == len(held)


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace as Of

    from siktverk.sources.durable import Steps, checkpoint_dir

    none = Of(isDefined=lambda: False)
    fake = Of(sparkContext=Of(_jsc=Of(sc=lambda: Of(getCheckpointDir=lambda: none)), master="spark://host:7077"), conf=Of(get=lambda k, d: d))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(fake)
    steps = Steps(spark)
    for k in range(3):
        df = steps.next(spark.range(k))
    assert df.count() == 2
    steps.drop()
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(steps.folder).count()


def test_positions_over_many_partitions(spark):
    from pyspark.sql import functions as F

    from siktverk.operators.ordering import numbered, numbered_within

    df = spark.range(1000, numPartitions=40).withColumn("g", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    got = {r["id"]: r["position"] for r in numbered(df, [F.desc("id")]).collect()}
    assert got == {k: 1000 - k for k in range(1000)}
    inside = {r["id"]: r["p"] for r in numbered_within(df, "g", [F.asc("id")], "p").collect()}
    assert all(inside[k] == k // 3 + 1 for k in range(1000))
