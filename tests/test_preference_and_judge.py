from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from siktverk.functions.judge import combined_score, parsed_score
from siktverk.operators import judging, preference, training
from siktverk.sources import readers, sinks
from siktverk.sources.readers import RESPONSES
from siktverk.streaming import responses as stream

PAIRS = "pair_id string, pair_kind string, is_duplicate boolean, doc_a_id string, doc_b_id string, doc_a_content_quality string, doc_b_content_quality string, doc_a_educational_value string, doc_b_educational_value string, calibration_correct_doc string"


@pytest.fixture(scope="module")
def study(spark):
    pairs = spark.createDataFrame([
        ("p1", "real", False, "<urn:uuid:A>", "b", "good", "poor", "high", "none", None),
        ("p2", "real", True, "a", "c", "good", "good", "basic", "high", None),
        ("k1", "calibration_readability", False, "a", "d", "poor", "good", "none", "high", "b"),
    ], PAIRS)
    r = lambda i, who, pair, kind, dup, side, read, sub, skip=0: (i, who, pair, kind, dup, 0, 1, side, read, sub, skip, None, 1000 + int(i), "2024-01-01T00:00:00Z")
    rows = [
        r("1", "Ann ", "p1", "real", 0, "a_left", "a_much", "b_slight"),
        r("1", "Ann ", "p1", "real", 0, "a_left", "a_much", "b_slight"),
        r("2", "bo", "p1", "real", 0, "a_right", "b_slight", "a_much"),
        r("3", "ann", "p2", "real", 1, "a_left", "a_slight", None),
        r("4", "bo", "p2", "real", 1, "a_right", "b_much", "b_much"),
        r("5", "bo", "k1", "calibration_readability", 0, "a_right", "a_much", "a_much"),
        r("6", "ann", "p1", "real", 0, "a_left", None, None, 1),
        r("7", "ann", "gone", "real", 0, "a_left", "a_much", "a_much"),
    ]
    return spark.createDataFrame(rows, RESPONSES), pairs


def test_agreement(study):
    rated = preference.rated(*study)
    got = {r["response_id"]: (r["chosen_read_doc"], r["readability_agr"], r["chosen_sub_doc"], r["substance_agr"], r["axes_diverged"]) for r in rated.collect()}
    assert got == {
        "1": ("a", "agree", "b", "disagree", True), "2": ("a", "agree", "b", "disagree", True),
        "3": ("a", "tie", None, "missing", False), "4": ("a", "tie", "a", "disagree", False),
    }
    rates = {r["axis"]: (r["agree"], r["disagree"], r["tie"], r["missing"], r["rate"]) for r in preference.agreement_rates(rated).collect()}
    assert rates == {"readability": (2, 0, 2, 0, 1.0), "substance": (0, 3, 0, 1, 0.0)}
    assert preference.separability(rated).first()["rate"] == pytest.approx(2 / 3)


def test_inter_rater_and_boards(study):
    responses, pairs = study
    i = {r["axis"]: r for r in preference.inter_rater(responses).collect()}
    assert (i["readability"]["rater_pairs"], i["readability"]["same_document"], i["readability"]["same_choice"]) == (1, 1, 0)
    d = {r["rater_name"]: r for r in preference.dashboard(responses, pairs).collect()}
    assert d["ann"]["total"] == 4 and d["ann"]["skipped"] == 1 and d["bo"]["cal_read_count"] == 1
    assert d["bo"]["cal_read_accuracy"] == 1.0 and d["ann"]["cal_read_accuracy"] is None
    assert {r["rater_name"]: (r["correct"], r["total"]) for r in preference.calibration(responses, pairs).collect()} == {"bo": (1, 1)}
    assert {r["rater_name"]: r["n"] for r in preference.timing(responses).collect()} == {"ann": 3, "bo": 3}


def test_bradley_terry(study, spark):
    won = preference.outcomes(*study)
    assert won.count() == 7  # real pairs only; an axis that was answered alone counts
    table = {r["doc_id"]: (r["wins"], r["losses"]) for r in preference.win_loss(won).collect()}
    assert sum(w for w, _ in table.values()) == 7 == sum(x for _, x in table.values())
    chain = spark.createDataFrame([("x", "y")] * 3 + [("y", "z")] * 3 + [("z", "y")], "winner string, loser string")
    s = {r["doc_id"]: r["log_odds"] for r in preference.bradley_terry(chain, 60).collect()}
    assert s["x"] > s["y"] > s["z"] and abs(sum(s.values())) < 1e-3
    assert preference.bradley_terry(chain.limit(0), 5).count() == 0


def test_bradley_terry_converges(spark):
    """A chain of unequal outcomes, against 5,000 plain updates."""
    games = {(i, i + 1): 9 for i in range(4)} | {(i + 1, i): 1 for i in range(4)}
    x = [1.0] * 6  # the last is the ghost
    for _ in range(5000):
        new = [(0.5 + sum(n for (a, _), n in games.items() if a == i)) / (1 / (x[i] + x[5]) + sum(n / (x[a] + x[b]) for (a, b), n in games.items() if i in (a, b))) for i in range(5)]
        new.append(2.5 / sum(1 / (v + x[5]) for v in x[:5]))
        x = [v / math.prod(new) ** (1 / 6) for v in new]
    logs = [math.log(v) for v in x[:5]]
    won = spark.createDataFrame([(f"d{a}", f"d{b}") for (a, b), n in games.items() for _ in range(n)], "winner string, loser string")
    got = {r["doc_id"]: r["log_odds"] for r in preference.bradley_terry(won).collect()}
    assert all(abs(got[f"d{i}"] - (logs[i] - sum(logs) / 5)) < 1e-3 for i in range(5))


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ('{"educational_value": 0.7, "content_quality": 0.4}', (0.7, 0.4)),
        ('text {"educational_value": 0.5, "content_quality": 0.5} text', (0.5, 0.5)),
        ("educational_value: 0.4\ncontent_quality: 0.8", (0.4, 0.8)),
        ("no numbers here", (None, None)),
        ('{"score": 1}', (None, None)),
        ("", (None, None)),
        (None, (None, None)),
        ('{"educational_value": 0.6}', (0.6, None)),
        ('{"educational_value": 1.5, "content_quality": -0.3}', (1.0, 0.0)),
    ],
)
def test_parsing(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert tuple(df.select(parsed_score("raw", "educational_value"), parsed_score("raw", "content_quality")).first()) == expected


def test_combination(spark):
    df = spark.createDataFrame([(0.9, 0.2), (0.5, None), (None, 0.5)], "e double, q double").select(combined_score("e", "q"))
    assert [r[0] for r in df.collect()] == [pytest.approx(0.55), None, None]


def test_judging_resumes_and_keeps_failures(spark):
    texts = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "doc_id string, text string")
    done = spark.createDataFrame([("a", None)], "doc_id string, quality_score double")
    rows = {r["doc_id"]: r for r in judging.judge(texts, "{id} {text}", done=done, pause=0).collect()}
    assert set(rows) == {"b", "c"} and rows["b"]["quality_score"] is not None
    bad = judging.judge(texts, "{text}", scorer=lambda t: "nothing", attempts=2, pause=0).collect()
    assert all(r["quality_score"] is None and r["raw_response"] == "nothing" for r in bad)
    s = judging.summary(judging.judge(texts, "{text}", scorer=lambda t: "nothing", attempts=1, pause=0)).first()
    assert (s["n"], s["failed"]) == (3, 3)
    assert judging.cost(texts, 100, 1.0, 1.0).first()["output_tokens"] == 90


def test_outputs(spark):
    scores = spark.createDataFrame([("a", 0.1, 0.3, 0.2), ("b", None, None, None)], "doc_id string, educational_value double, content_quality double, quality_score double")
    manifest = spark.createDataFrame([("a", "a", "x"), ("b", "b", "y")], "doc_id string, id string, content_type string")
    out = sinks.score_outputs(scores, manifest, ["id", "quality_score", "content_type", "absent"])
    assert out["deliverable"].columns == ["id", "quality_score"] and out["axes"].columns == list(sinks.AXES)
    assert [tuple(r) for r in out["combined"].orderBy("id").collect()] == [("a", 0.2, "x", None), ("b", None, "y", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", True, 1, 1), ("b", False, None, 2)], "doc_id string, in_top_k boolean, rank_l2 int, rank_l1 int")
    sinks.write_ranking(df, f"{tmp_path}/r", "ndjson", {"rows": 2})
    assert spark.read.json(f"{tmp_path}/r").count() == 2 and sinks.read_json(f"{tmp_path}/r.report.json") == {"rows": 2}
    assert '"doc_id":"a"' in sinks.preview(df, 5)
    sinks.write_once(df, f"{tmp_path}/o")
    sinks.write_once(df.limit(0), f"{tmp_path}/o")
    assert spark.read.parquet(f"{tmp_path}/o").count() == 2
    new = spark.createDataFrame([("a", 9), ("c", 9)], "doc_id string, rank_l1 int")
    old = df.select("doc_id", "rank_l1")
    assert {tuple(r) for r in sinks.upsert(old, new, ["doc_id"]).collect()} == {("a", 1), ("b", 2), ("c", 9)}
    assert {tuple(r) for r in sinks.upsert(old, new, ["doc_id"], True).collect()} == {("a", 9), ("b", 2), ("c", 9)}
    text = sinks.metrics_markdown([{"method": "m", "n": 3, "spearman": float("nan")}], {"rows": 3}, {"x": -2.0, "y": 1.0})
    assert "n/a" in text and text.index("| x |") < text.index("| y |")
    page = sinks.inspection_html(spark.createDataFrame([("1", "g", "<b>")], "id string, q string, t string"), "q", "T", ["t"])
    assert "&lt;b&gt;" in page


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;x\n1;2\n", encoding="utf-8")
    assert readers.read_local(spark, f"{tmp_path}/a.csv").columns == ["id", "x"]
    with pytest.raises(FileNotFoundError):
        readers.open_with_fallback(spark, f"{tmp_path}/none", "sv")
    corpus = spark.createDataFrame([("a", "one"), ("<urn:uuid:a>", "two"), ("b", "three")], "id string, text string")
    want = spark.createDataFrame([("a",), ("b",)], "id string")
    cache = spark.createDataFrame([("a", "alpha")], "id string, text string")
    assert {tuple(r) for r in readers.fetch_texts(corpus, want, cache).collect()} == {("a", "alpha"), ("b", "three")}
    assert readers.fetch_texts(None, want, cache).count() == 1
    assert readers.resolve_split(["train", "swe_Latn"], "xx") == "swe_Latn"
    with pytest.raises(ValueError):
        readers.validated_shard(corpus.withColumnRenamed("id", "k"), want)
    assert readers.scan(corpus, ["id", "absent"], 2).columns == ["id", "absent"]


def test_stream(spark, study, tmp_path):
    responses, _ = study
    responses.write.parquet(f"{tmp_path}/in")
    rows = stream.first_answers(stream.read_responses(spark, f"{tmp_path}/in")).select("rater_name", "pair_id")
    stream.run_to(rows, f"{tmp_path}/out", f"{tmp_path}/state")
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) == len(set(got)) == 7


def test_pairwise_trainer():
    import numpy as np

    x = np.array([[0.1] * 7, [0.5] * 7, [0.9] * 7])
    y = np.array([0.1, 0.6, 0.95])
    w = training.fit_linear(x, y, 0.01, 1.0, epochs=30)
    assert list(np.argsort(x @ w)) == [0, 1, 2] and training.recall(x @ w, y, 50) >= 0.5
    r = np.random.default_rng(0)
    z = r.normal(size=(200, 3))
    rel = np.clip(np.round(z[:, 0] + 2), 0, 4)
    m = training.Lambda(20, 0.2).fit(z, rel, [np.arange(k, k + 20) for k in range(0, 200, 20)])
    assert np.corrcoef(m.predict(z), z[:, 0])[0, 1] > 0.8
    assert not training.fit_linear(x, np.ones(3), 0.01, 1.0).any()


def test_choice_of_null(spark):
    df = spark.createDataFrame([(None, "a_left"), ("a_much", None)], "c string, s string")
    assert [r[0] for r in df.select(preference.chosen(F.col("c"), F.col("s"))).collect()] == [None, None]


@pytest.fixture()
def counted(tmp_path):
    """A judge that answers in words at first, once without a score, and fails on one text; its calls are files, as workers make them."""
    import uuid

    def judge(text):
        (tmp_path / f"{text}-{uuid.uuid4().hex}").touch()
        if text == "fails":
            raise RuntimeError("no connection")
        if text == "words":
            return "Educational value: 0.3, Content quality: 0.4"
        return '{"educational_value": null, "content_quality": "n/a"}' if text == "empty" else '{"educational_value": 0.5, "content_quality": 0.7}'

    return judge, lambda text: len(list(tmp_path.glob(f"{text}-*")))


def test_a_call_is_repeated_until_both_axes_are_read(spark, counted):
    judge, calls = counted
    texts = spark.createDataFrame([("a", "words"), ("b", "empty"), ("c", "fails"), ("d", "good")], "doc_id string, text string").coalesce(1)
    rows = {r["doc_id"]: r for r in judging.judge(texts, "{text}", scorer=judge, pause=0).collect()}
    assert (calls("words"), calls("empty"), calls("fails"), calls("good")) == (1, 3, 3, 1)
    assert rows["a"]["quality_score"] == pytest.approx(0.35) and rows["b"]["quality_score"] is None and rows["c"]["raw_response"].startswith("error: no conn")


def test_judging_keeps_what_it_has(spark, tmp_path, counted):
    judge, calls = counted
    texts = spark.createDataFrame([(f"d{i}", f"t{i}") for i in range(12)], "doc_id string, text string")
    path = str(tmp_path / "scores")

    def breaks(text):
        judge(text)
        if text == "t7":
            raise KeyboardInterrupt
        return judge("good")

    with pytest.raises(Exception):  # noqa: B017
        judging.judge_to(texts, "{text}", path, breaks, every=2, pause=0)
    held = {r["doc_id"] for r in spark.read.parquet(path).collect()} if (tmp_path / "scores").exists() else set()
    before = {i: calls(f"t{i}") for i in range(12)}
    out = judging.judge_to(texts, "{text}", path, judge, every=2, pause=0)
    assert out.count() == 12 and out.select("doc_id").distinct().count() == 12
    assert all(calls(f"t{i}") == before[i] for i in range(12) if f"d{i}" in held)
    assert judging.judge_to(texts, "{text}", path, judge, pause=0).count() == 12


def test_disagreements(spark):
    human = spark.createDataFrame([(f"<urn:uuid:D{i}>", i / 10) for i in range(8)] + [("n", None)], "doc_id string, score double")
    scores = spark.createDataFrame([(f"d{i}", 0.3) for i in range(8)], "doc_id string, quality_score double")
    both = judging.human_and_judge(human, scores)
    assert both.count() == 8
    got = [(r["side"], r["place"], r["doc_id"]) for r in judging.disagreements(both, 2).orderBy("side", "place").collect()]
    assert got == [("human", 1, "d7"), ("human", 2, "d6"), ("judge", 1, "d0"), ("judge", 2, "d1")]


def test_next_tasks(spark):
    queue = spark.createDataFrame([("Ann ", "p1", 0), ("ann", "p2", 1), ("ann", "p3", 2), ("bo", "p1", 0)], "rater_name string, pair_id string, queue_position int")
    done = spark.createDataFrame([("ann", "p1", 1), ("ANN", "p2", 0), ("bo", "p1", 0)], "rater_name string, pair_id string, skipped int")
    assert [tuple(r) for r in preference.next_tasks(queue, done).collect()] == [("ann", 2, "p3")]


def test_texts_are_kept_and_sizes_told(spark, tmp_path):
    from siktverk.sources import readers

    corpus = spark.createDataFrame([("<urn:uuid:A>", "one"), ("b", "two")], "id string, text string")
    path = str(tmp_path / "cache")
    first = readers.first_texts(corpus, spark.createDataFrame([("a",)], "id string"), path=path)
    assert [r["text"] for r in first.collect()] == ["one"]
    both = readers.fetch_texts(corpus.filter("text = 'two'"), spark.createDataFrame([("a",), ("b",)], "id string"), path=path)
    assert {r["text"] for r in both.collect()} == {"one", "two"}
    sizes = {r["name"]: r for r in readers.file_sizes(spark, str(tmp_path)).collect()}
    assert sizes["cache"]["bytes"] > 0 and sizes["cache"]["size"].endswith("B")
    assert [r[0] for r in spark.createDataFrame([(5,), (2048,), (3 * 1024**4,)], "b bigint").select(readers.human_bytes(F.col("b"))).collect()] == ["5.0 B", "2.0 KB", "3.0 TB"]
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return 7

    assert readers.retried(flaky, pause=0) == 7 and len(tries) == 3


def test_clock_and_judge_config(spark):
    from siktverk.functions import clock
    from siktverk.plans.config import Judge

    df = spark.createDataFrame([("2024-05-01T10:00:00Z", "2024-05-01T10:04:10.500Z"), (None, "x")], "a string, b string")
    rows = df.select(clock.elapsed_seconds("a", "b"), clock.left_of_break("a", "b"), clock.iso_text(clock.parsed_time("a"))).collect()
    assert tuple(rows[0]) == (250.5, 350, "2024-05-01T10:00:00.000000Z") and rows[1][0] is None
    assert Judge.resolve("openai", "m", base_url="http://x").base_url == "http://x" and not Judge.resolve("anthropic", "m").openai_compatible
    with pytest.raises(ValueError, match="no such provider"):
        Judge.resolve("other", "m")
    assert sinks.percentage(1, 0) == "n/a" and sinks.percentage(1, 8) == "12.5%"


def test_late_answers_are_dropped(spark, tmp_path):
    base = ("bo", "real", 0, 0, 1, "a_left", "a_much", "a_much", 0, None, 5)
    row = lambda i, pair, at: (str(i), base[0], pair, *base[1:], at)
    for k, rows in enumerate(([row(1, "p1", "2024-05-01T10:00:00Z")], [row(2, "p2", "2024-05-03T10:00:00Z"), row(3, "p2", "2024-05-03T10:30:00Z")], [row(4, "p3", "2024-05-01T11:00:00Z"), row(5, "p4", "2024-05-03T10:10:00Z")])):
        spark.createDataFrame(rows, RESPONSES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = stream.first_answers(stream.read_responses(spark, f"{tmp_path}/in", 1), "1 hour").select("pair_id")
        stream.run_to(out, f"{tmp_path}/out", f"{tmp_path}/state")  # each run goes on where the last one ended
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["p1", "p2", "p4"]  # p3 came two days late
