from __future__ import annotations

import itertools
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siktverk.operators import joins, metrics, sampling

def allocated(spark, held, wanted, mode):
    df = spark.createDataFrame(sorted(held.items()), "k int, n bigint")
    return {r["k"]: r["given"] for r in sampling.allocation(df, ["k"], wanted, mode).collect()}


def test_allocations_sum_and_fit(spark):
    r = random.Random(3)
    for _ in range(8):
        held = {k: r.randint(1, 60) for k in range(r.randint(1, 8))}
        wanted = r.randint(0, 300)
        for mode in ("uniform", "proportional"):
            got = allocated(spark, held, wanted, mode)
            assert sum(got.values()) == min(wanted, sum(held.values())), (held, wanted, mode, got)
            assert all(0 <= got[k] <= held[k] for k in held)
        even = allocated(spark, held, wanted, "uniform")
        level = max(even.values())
        assert all(g >= level - 1 or g == held[k] for k, g in even.items())


def test_allocations(spark):
    assert allocated(spark, {1: 500, 2: 20, 3: 20, 4: 20}, 80, "uniform") == {1: 20, 2: 20, 3: 20, 4: 20}
    assert allocated(spark, {1: 5, 2: 50, 3: 50}, 24, "uniform") == {1: 5, 2: 10, 3: 9}
    p = allocated(spark, {1: 500, 2: 20, 3: 20, 4: 20}, 80, "proportional")
    assert p == {1: 67, 2: 5, 3: 4, 4: 4}
    assert allocated(spark, {1: 500, 2: 20, 3: 20}, 3, "proportional") == {1: 2, 2: 1, 3: 0}
    assert allocated(spark, {}, 3, "uniform") == {}


def test_duplicates_rows_and_reuse(spark):
    pairs = spark.createDataFrame([(f"a{i}", "hub" if i < 6 else f"b{i}") for i in range(12)], "a string, b string")
    marked = sampling.mark_duplicates(pairs, 3).collect()
    assert len(marked) == 12 and sum(r["is_duplicate"] for r in marked) == 3
    docs = spark.createDataFrame([("a0", None, 1), ("hub", "text", 2)], "id string, text string, pair_id int")
    rows = sampling.pair_rows(pairs.withColumn("pair_kind", F.lit("real")), docs, ["text"]).collect()
    assert [(r["doc_a_id"], r["doc_b_id"], r["doc_a_text"], r["doc_b_text"]) for r in rows] == [("a0", "hub", "", "text")] and len(rows[0]["pair_id"]) == 36
    u = sampling.reuse(pairs).first()
    assert (u["distinct_documents"], u["median_uses"], u["p90_uses"], u["max_uses"]) == (19, 1, 1, 6)
    assert sampling.reuse(pairs.limit(0)).first()["distinct_documents"] == 0


def test_stratified_sample(spark):
    df = spark.createDataFrame([(f"d{i}", i % 3, i % 2) for i in range(240)], "id string, edu_ord int, quality_ord int")
    rows = sampling.stratified_sample(df, ["edu_ord", "quality_ord"], 60).collect()
    assert len(rows) == 60 and len({r["id"] for r in rows}) == 60 and {r["stratum_weight"] for r in rows} == {1.0}
    again = {r["id"] for r in sampling.stratified_sample(df.repartition(3), ["edu_ord", "quality_ord"], 60).collect()}
    assert again == {r["id"] for r in rows}
    assert sampling.stratified_sample(df.limit(0), ["edu_ord", "quality_ord"], 60).count() == 0
    assert sampling.stratified_sample(df, ["edu_ord", "quality_ord"], 1000).count() == 240


@given(st.dictionaries(st.text(max_size=3), st.integers(1, 500), min_size=1, max_size=5))
def test_quotas(held):
    q = sampling.quotas(held)
    assert sum(q.values()) == 99 and min(q.values()) >= 1


def test_eyeball_sizes(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 900 + [("c",)] * 97, "s string")
    assert {r["s"]: r["take"] for r in sampling.eyeball_sizes(df, "s").collect()} == {"a": 3, "b": 25, "c": 25}


def test_training_groups(spark):
    df = spark.createDataFrame([(f"d{i}", "report", 1) for i in range(9)] + [("x", "alone", 2)], "doc_id string, content_type string, length int")
    rows = sampling.training_groups(df, ["content_type", "length"], 4, 2).collect()
    assert len(rows) == 8 and {r["content_type"] for r in rows} == {"report"}
    assert all(len({r["doc_id"] for r in rows if r["group"] == g}) == 4 for g in (0, 1))


def test_pairs_are_capped_and_calibrated(spark):
    pairs = spark.createDataFrame([(a, b) for a, b in itertools.combinations([f"d{i}" for i in range(12)], 2)], "a string, b string")
    used: dict[str, int] = {}
    for r in sampling.capped_pairs(pairs, 3).collect():
        for d in (r["a"], r["b"]):
            used[d] = used.get(d, 0) + 1
    assert used and max(used.values()) <= 3
    df = spark.createDataFrame([("w1", "f", 0), ("w2", "g", 0), ("b1", "f", 1), ("b2", "h", 1)], "id string, family string, good int")
    rows = sampling.matched_calibration(df, F.col("good") == 0, F.col("good") == 1, "family", 5, 1).collect()
    assert {(r["a"], r["b"], r["same_family"]) for r in rows} == {("w1", "b1", True), ("w2", "b2", False)}


def test_pairs_are_drawn_from_the_full_relation(spark):
    rows = [(f"d{i}", "big", i % 4) for i in range(700)] + [(f"s{i}", "small", i) for i in range(3)] + [("x", "alone", 2)]
    df = spark.createDataFrame(rows, "id string, family string, bucket int")
    label = {k: (f, b) for k, f, b in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(label), 2) if label[a][0] == label[b][0] and abs(label[a][1] - label[b][1]) <= 1}
    assert {(r["a"], r["b"]) for r in joins.band_pairs(df, "family", "bucket", "id").collect()} == want
    assert sum(r["partners"] for r in joins.band_classes(df, "family", "bucket", "id").collect()) == 2 * len(want)
    got = sampling.drawn_pairs(df, "family", "bucket", "id").collect()
    used = [d for r in got for d in (r["a"], r["b"])]
    assert len({(r["a"], r["b"]) for r in got}) == len(got) == 99 and max(used.count(d) for d in used) <= 5
    assert all(abs(label[r["a"]][1] - label[r["b"]][1]) <= 1 for r in got) and "small" in {r["family"] for r in got}
    assert all((r["a"], r["b"]) in want for r in got if r["family"]) and sum(r["family"] is None for r in got) <= 1
    assert sampling.drawn_pairs(df.limit(0), "family", "bucket", "id").count() == 0


def test_queue(spark):
    rows = [(f"p{i}", "real", False) for i in range(99)] + [(f"q{i}", "real", True) for i in range(9)] + [(f"c{i}", "calibration_substance", False) for i in range(9)]
    df = spark.createDataFrame(rows, "pair_id string, pair_kind string, is_duplicate boolean")
    seen = []
    for slot in range(3):
        q = sampling.rater_queue(df, f"r{slot}", slot).orderBy("queue_position").collect()
        assert [r["queue_position"] for r in q] == list(range(45)) and len({r["pair_id"] for r in q}) == 45
        assert [r["queue_position"] for r in q if r["pair_id"][0] == "c"] == list(sampling.CALIBRATION_AT)
        assert [r["session_num"] for r in q] == [1] * 15 + [2] * 15 + [3] * 15
        seen.append({r["pair_id"] for r in q if r["pair_id"][0] == "p"})
    assert not (seen[0] & seen[1] or seen[1] & seen[2])
    with pytest.raises(ValueError):
        sampling.rater_queue(df, "r", 3)


def test_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.5,), (0.99,), (1.0,), (None,), (1.4,)], "y double")
    assert [r[0] for r in df.select(metrics.relevance_bin("y")).collect()] == [0, 0, 4, 7, 7, None, 7]
    assert [r["n"] for r in metrics.bin_histogram(df, "y").orderBy("bin").collect()] == [2, 0, 0, 0, 1, 0, 0, 3]


def test_bundle(spark):
    rows = [("m", f"d{i}", float(s), g) for i, (s, g) in enumerate(zip([3, 2, 1], [0.9, 0.5, 0.1]))]
    r = metrics.bundle(spark.createDataFrame(rows, "method string, doc_id string, score double, gold double"), (50,), (3, 10)).first()
    assert r["spearman"] == pytest.approx(1.0) and r["recall_50"] == 1.0 and r["ndcg_3"] == pytest.approx(1.0) and r["ndcg_10"] is None


def test_statistics_against_brute_force(spark):
    r = random.Random(4)
    rows = [(f"d{i}", r.randint(0, 4) / 4, r.randint(0, 4) / 4) for i in range(60)] + [("n", None, 0.5)]
    df = spark.createDataFrame(rows, "doc_id string, x double, y double")
    k = metrics.kendall_b(df, "x", "y").first()
    pts = [(a, b) for _, a, b in rows if a is not None]
    con = sum((a - c) * (b - d) > 0 for (a, b), (c, d) in itertools.combinations(pts, 2))
    dis = sum((a - c) * (b - d) < 0 for (a, b), (c, d) in itertools.combinations(pts, 2))
    assert (k["concordant"], k["discordant"]) == (con, dis)
    g = df.withColumn("g", F.when(F.col("y") >= 0.5, "hi").otherwise("lo"))
    one, two = metrics.mann_whitney(g, "g", "hi", "lo", "x").first(), metrics.mann_whitney(g, "g", "lo", "hi", "x").first()
    assert one["auc"] + two["auc"] == pytest.approx(1.0) and 0 <= one["p_greater"] <= 1
    flat = df.withColumn("x", F.lit(1.0))
    assert metrics.correlations(flat, "x", "y").first()["pearson"] is None and metrics.spearman_average(flat, "x", "y").first()[0] is None


def test_latin_share(spark):
    df = spark.createDataFrame([("abc",), ("abв",), ("12",), (None,)], "t string")
    assert [r[0] for r in df.select(metrics.latin_share("t")).collect()] == [1.0, pytest.approx(2 / 3), None, None]


def brute_tau(rows):
    c = d = tx = ty = 0
    for (x, y), (u, v) in itertools.combinations(rows, 2):
        c += (x - u) * (y - v) > 0
        d += (x - u) * (y - v) < 0
        tx, ty = tx + (x == u), ty + (y == v)
    return c, d, tx, ty


def test_kendall_on_values_of_any_kind(spark):
    r = random.Random(5)
    for rows in (
        [(r.random(), r.random()) for _ in range(400)],
        [(r.randint(0, 5), r.randint(0, 3)) for _ in range(300)],
        [(1.0, r.random()) for _ in range(100)] + [(r.random(), 0.5) for _ in range(100)] + [(2.0, 2.0)] * 90,
    ):
        rows = [(float(x), float(y)) for x, y in rows]
        df = spark.createDataFrame([*rows, (None, 1.0), (1.0, None)], "x double, y double")
        got = metrics.kendall_b(df, "x", "y").first()
        c, d, tx, ty = brute_tau(rows)
        assert (got["concordant"], got["discordant"], got["ties_x"], got["ties_y"]) == (c, d, tx, ty)
        n = len(rows) * (len(rows) - 1) / 2
        assert got["tau_b"] == pytest.approx((c - d) / ((n - tx) * (n - ty)) ** 0.5)
    assert metrics.kendall_b(df.limit(0), "x", "y").first()["tau_b"] is None


def test_p_values(spark):
    assert metrics.student_p(2.2281388519649385 / (2.2281388519649385**2 + 10) ** 0.5, 12) == pytest.approx(0.05, abs=1e-9)
    assert metrics.student_p(0.0, 20) == pytest.approx(1.0) and metrics.student_p(None, 5) is None and metrics.student_p(1.0, 5) == 0.0
    rows = [(float(i), float((i * 7) % 10)) for i in range(30)]
    got = {r["method"]: r for r in metrics.correlation_tests(spark.createDataFrame(rows, "x double, y double"), "x", "y").collect()}
    assert set(got) == {"pearson", "spearman", "kendall"} and all(r["n"] == 30 and 0 < r["p_value"] <= 1 for r in got.values())


def test_quantiles_interpolate(spark):
    import numpy as np

    from siktverk.operators.ordering import quantiles

    r = random.Random(2)
    rows = [(g, float(r.choice([1, 2, 2, 3.5, 10, r.random()]))) for g in "abc" for _ in range(r.randint(1, 90))] + [("a", None), (None, 4.0)]
    got = {x["g"]: x for x in quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"q1": 0.1, "q5": 0.5}).collect()}
    assert set(got) == {"a", "b", "c", None} and got[None]["q5"] == 4.0
    for g in "abc":
        own = [v for k, v in rows if k == g and v is not None]
        assert got[g]["q1"] == pytest.approx(np.quantile(own, 0.1)) and got[g]["q5"] == pytest.approx(np.quantile(own, 0.5))


def test_head_and_tail(spark):
    from siktverk.operators.ranking import head_and_tail

    df = spark.createDataFrame([(f"d{i}", i / 10) for i in range(8)] + [("n", None)], "id string, s double")
    got = {(r["end"], r["id"]) for r in head_and_tail(df, "s", "id", 2).collect()}
    assert got == {("head", "d7"), ("head", "d6"), ("tail", "d0"), ("tail", "d1")}
