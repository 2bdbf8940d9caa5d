from __future__ import annotations

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siktverk.functions.ids import bare_id, canonical_id, hash_split
from siktverk.operators import features, joins, ranking
from siktverk.operators.ordering import numbered, running_counts
from siktverk.plans.config import HardFilter, Pipeline, Priority, Ranking, load_config, save_config

ANN = "id string, content_quality string, information_density string, educational_value string, safety string, pii_presence string, content_length string, content_type string"
ROWS = [
    ("a", "very_high", "dense", "very_high", "very_safe", "no_pii", "substantial", "report"),
    ("b", "high", "dense", "high", "safe", "no_pii", "moderate", "report"),
    ("c", "medium", "moderate", "medium", "safe", "no_pii", "brief", "manual"),
    ("d", "low", "sparse", "low", "unsafe", "contains_pii", "brief", "manual"),
]
META = "id string, full_doc_lid string, full_doc_lid_score double, minhash_cluster_size bigint, duplicate_count bigint"
METAROWS = [("a", "swe_Latn", 0.99, 1, 0), ("b", "swe_Latn", 0.97, 2, 1), ("c", "swe_Latn", 0.95, 5, 2), ("d", "eng_Latn", 0.93, 1, 0), ("unmatched", "swe_Latn", 0.9, 1, 0)]


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(ROWS, ANN), spark.createDataFrame(METAROWS, META)


def test_ids(spark):
    df = spark.createDataFrame([("<urn:uuid:AB>",), (" ab ",), ("ab",), (None,), ("",)], "id string")
    assert [r[0] for r in df.select(canonical_id("id")).collect()] == ["AB", " ab ", "ab", None, ""]
    assert [r[0] for r in df.select(bare_id("id")).collect()] == ["ab", "ab", "ab", None, ""]


def test_features_and_filter(frames):
    joined = joins.join_metadata(*frames)
    f = features.to_features(joined)
    rows = {r["doc_id"]: r for r in features.hard_filter(f, "swe_Latn").collect()}
    assert [rows[k]["pii_absence"] for k in "abcd"] == [1, 1, 1, 0]
    assert [rows[k]["length"] for k in "abcd"] == [3, 2, 1, 1]
    assert rows["a"]["language_confidence"] == 0.99 and rows["a"]["safety"] == 4
    assert [rows[k]["passed_hard_filter"] for k in "abcd"] == [True, True, True, False]


def test_filter_is_three_valued(spark):
    df = spark.createDataFrame([(None, 3), ("swe_Latn", None), ("eng_Latn", None)], "full_doc_lid string, content_quality bigint")
    out = [r[0] for r in features.hard_filter(df, "swe_Latn", {"content_quality": 2}).select("passed_hard_filter").collect()]
    assert out == [None, None, False]


def test_unknown_labels_and_missing_columns_are_null(spark):
    r = features.to_features(spark.createDataFrame([("x", "GOOD", None), ("y", "odd", 1)], "id string, content_quality string, duplicate_count bigint")).orderBy("id").collect()
    assert [x["content_quality"] for x in r] == [3, None] and r[0]["safety"] is None and r[0]["duplicate_count"] == 0.0


def test_nearest_rank_stats(spark):
    values = [0.0, 1.0, 1.0, 2.0, 50.0, None]
    s = features.nearest_rank_stats(spark.createDataFrame([(v, 7.0, None) for v in values], "x double, c double, e double"), ["x", "c", "e"])
    assert (s["x"]["p1"], s["x"]["p99"]) == (0.0, 50.0)
    assert s["x"]["mean"] == pytest.approx(10.8) and s["x"]["std"] == pytest.approx(21.9248717)
    assert (s["c"]["p1"], s["c"]["p99"], s["c"]["std"]) == (7.0, 8.0, 1.0)
    assert s["e"] == {"p1": 0.0, "p99": 1.0, "mean": 0.0, "std": 1.0}


def test_scaling_keeps_null_and_stays_in_range(spark):
    df = spark.createDataFrame([(-5.0,), (0.5,), (9.0,), (None,)], "x double").select(features.scaled(F.col("x"), {"p1": 0.0, "p99": 2.0}))
    assert [r[0] for r in df.collect()] == [0.0, 0.25, 1.0, None]


def test_pipeline(frames):
    ann, meta = frames
    p = ranking.prepare(joins.join_metadata(ann, meta), "swe_Latn")
    out = ranking.finalize(ranking.rank_l2(ranking.rank_l1(p), 2, 2))
    rows = out.collect()
    assert tuple(out.columns) == ranking.OUTPUT and sum(r["in_top_k"] for r in rows) == 2
    assert [r["rank_l1"] for r in sorted(rows, key=lambda r: r["doc_id"])] == [1, 2, 3, None]
    assert joins.join_report(ann, meta).first()["unmatched_metadata"] == 1
    off = ranking.rank_l2(ranking.rank_l1(p), 1, 2, "disabled").collect()
    assert sum(r["in_top_k"] for r in off) == 1 and all(r["rank_l2"] is None for r in off)


def test_no_survivors_and_empty(spark, frames):
    p = ranking.prepare(joins.join_metadata(*frames), "deu_Latn")
    rows = ranking.rank_l2(ranking.rank_l1(p), 2, 2).collect()
    assert len(rows) == 4 and not any(r["in_top_k"] for r in rows) and all(r["rank_l1"] is None for r in rows)
    empty = ranking.prepare(joins.join_metadata(frames[0].limit(0), frames[1]), "swe_Latn")
    assert ranking.rank_l2(ranking.rank_l1(empty), 2, 2).count() == 0


def test_repeated_ids_do_not_fan_out(frames):
    ann, meta = frames
    twice = joins.join_metadata(ann.unionByName(ann), meta)
    rows = ranking.rank_l1(ranking.prepare(twice, "swe_Latn")).filter("rank_l1 is not null").collect()
    assert sorted(r["rank_l1"] for r in rows) == [1, 2, 3, 4, 5, 6]


def test_credits_move_the_ranking(spark, frames):
    p = ranking.prepare(joins.join_metadata(*frames), "swe_Latn")
    unit = dict.fromkeys(features.FEATURES, 0.0) | {"length": 1.0}
    z = {r["doc_id"]: r["z_l1"] for r in ranking.rank_l1(p, unit=unit).collect()}
    assert z["a"] > z["b"] > z["c"] and z["d"] is None


def test_labels(spark):
    human = joins.load_labels(spark.createDataFrame([("abc", 1.2), ("def", -0.1)], "doc_id string, score double")).collect()
    assert [tuple(r) for r in human] == [("abc", 1.0), ("def", 0.0)]
    judged = joins.load_labels(spark.createDataFrame([("abc", 0.75)], "id string, quality_score double")).collect()
    assert [tuple(r) for r in judged] == [("abc", 0.75)]
    with pytest.raises(ValueError):
        joins.load_labels(spark.createDataFrame([("x",)], "id string"))
    df = spark.createDataFrame([("<urn:uuid:abc>", 1), ("zzz", 2)], "doc_id string, x int")
    twice = spark.createDataFrame([("abc", 0.2), ("abc", 0.4)], "doc_id string, gold_score double")
    assert [tuple(r) for r in joins.attach_labels(df, twice).collect()] == [("<urn:uuid:abc>", 1, 0.4)]


def test_lexicographic(spark):
    df = spark.createDataFrame([("a", 3, 4, "1"), ("b", 4, 1, "2"), ("c", 3, 4, "3"), ("d", None, 9, "4")], "doc_id string, cq bigint, edu bigint, h string")
    s = {r["doc_id"]: r["score"] for r in ranking.lexicographic(df, ["cq", "edu", "h"]).collect()}
    assert s == {"b": 4, "c": 3, "a": 2, "d": 1}
    e = {r["doc_id"]: r["score"] for r in ranking.lexicographic(df, ["edu", "cq", "h"]).collect()}
    assert e["d"] == 4 and e["b"] == 1


def test_numbered_and_running_counts(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = [(r["v"], r["id"], r["position"]) for r in numbered(df, [F.desc("v"), F.asc("id")]).orderBy("position").collect()]
    assert [g[2] for g in got] == list(range(1, 1001)) and got == sorted(got, key=lambda g: (-g[0], g[1]))
    counts = df.groupBy(F.lit("g").alias("g"), "v").agg(F.count("*").alias("n"))
    rows = sorted((r["v"], r["n"], r["before"], r["total"]) for r in running_counts(counts, "g", "v", "n").collect())
    assert rows[0][2] == 0 and all(b[2] == a[2] + a[1] for a, b in zip(rows, rows[1:])) and rows[0][3] == 1000
    assert numbered(df.limit(0), [F.asc("id")]).count() == 0 and running_counts(counts.limit(0), "g", "v", "n").count() == 0


def test_config(tmp_path):
    with pytest.raises(ValueError):
        Priority({f: 10.0 for f in features.FEATURES})
    with pytest.raises(ValueError):
        Ranking(k=0)
    with pytest.raises(ValueError):
        HardFilter(minimum={"odd": 1})
    save_config(Pipeline(ranking=Ranking(k=7)), tmp_path / "c.yaml")
    assert load_config(tmp_path / "c.yaml").ranking.k == 7
    assert math.isclose(sum(Pipeline().priority.unit().values()), 1)


@given(st.text(max_size=20))
def test_split_of_python_and_spark_agree(value):
    import hashlib

    u = int(hashlib.sha256(value.encode("utf-8", "replace")).hexdigest()[:8], 16) % 10000 / 10000
    assert 0 <= u < 1


def test_hash_split_is_stable(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("id")).select(hash_split("id").alias("s")).groupBy("s").count()
    n = {r["s"]: r["count"] for r in df.collect()}
    assert n["train"] > n["val"] + n["test"] and set(n) == {"train", "val", "test"}


def test_joins(spark):
    base = spark.createDataFrame([("a", 1)], "id string, x int")
    out = joins.aligned_union(base, spark.createDataFrame([("b", "7", "z"), ("c", "odd", "z")], "id string, x string, extra string")).collect()
    assert [tuple(r) for r in out] == [("a", 1), ("b", 7), ("c", None)]
    df = spark.createDataFrame([("a",), ("<urn:uuid:b>",), (None,)], "id string")
    kept = joins.without(df, spark.createDataFrame([("b",)], "id string")).collect()
    assert {r["id"] for r in kept} == {"a", None}
    assert joins.members(df, spark.createDataFrame([("b",)], "id string")).count() == 1


def test_band_pairs(spark):
    df = spark.createDataFrame([(f"d{i}", "f" if i % 2 else "g", i % 4) for i in range(400)], "id string, family string, bucket int")
    rows = joins.band_pairs(df, "family", "bucket", "id").collect()
    fam = {f"d{i}": ("f" if i % 2 else "g", i % 4) for i in range(400)}
    assert rows and len({(r["a"], r["b"]) for r in rows}) == len(rows)
    assert all(r["a"] < r["b"] and fam[r["a"]][0] == fam[r["b"]][0] and abs(fam[r["a"]][1] - fam[r["b"]][1]) <= 1 for r in rows)
