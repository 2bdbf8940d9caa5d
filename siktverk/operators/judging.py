"""Scoring documents with a model judge: prompts, cost, retries, resumption. The judge itself is pluggable."""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siktverk.functions.ids import bare_id
from siktverk.functions.judge import combined_score, parse_scores, parsed_score
from siktverk.operators.ordering import quantiles

#: Characters a token, tokens of an answer.
CHARS_PER_TOKEN, ANSWER_TOKENS, MAX_CHARS = 4, 30, 3000
Scorer = Callable[[str], str]


def prompt(template: str, id_column: str = "doc_id", text_column: str = "text", max_chars: int = MAX_CHARS) -> Column:
    """The template with ``{id}`` and then ``{text}`` filled in, the text cut to ``max_chars``."""
    with_id = F.replace(F.lit(template), F.lit("{id}"), F.col(id_column))
    return F.replace(with_id, F.lit("{text}"), F.left(F.coalesce(text_column, F.lit("")), F.lit(max_chars)))


def cost(texts: DataFrame, template_chars: int, price_in: float, price_out: float, max_chars: int = MAX_CHARS, text_column: str = "text") -> DataFrame:
    """One row ``documents, input_tokens, output_tokens, usd``; prices are per million tokens."""
    seen = F.lit(template_chars) + F.least(F.coalesce(F.length(text_column), F.lit(0)), F.lit(max_chars))
    s = texts.agg(F.count("*").alias("documents"), F.floor(F.coalesce(F.sum(seen), F.lit(0)) / CHARS_PER_TOKEN).alias("input_tokens"))
    s = s.withColumn("output_tokens", F.col("documents") * ANSWER_TOKENS)
    return s.withColumn("usd", F.col("input_tokens") / 1e6 * price_in + F.col("output_tokens") / 1e6 * price_out)


def stub(text: str) -> str:
    """Offline judge: scores from a hash of the prompt."""
    h = hashlib.sha256(text.encode()).digest()
    return json.dumps({"educational_value": round(h[0] / 255, 2), "content_quality": round(h[1] / 255, 2)})


def pending(texts: DataFrame, done: DataFrame | None) -> DataFrame:
    """Documents without a row in ``done``; a row with null scores counts as done."""
    return texts if done is None else texts.join(done.select("doc_id").distinct(), "doc_id", "left_anti")


def judge(texts: DataFrame, template: str, scorer: Scorer = stub, done: DataFrame | None = None, attempts: int = 3, pause: float = 1.0, max_chars: int = MAX_CHARS, parallel: int = 5) -> DataFrame:
    """``doc_id, educational_value, content_quality, quality_score, raw_response`` of the pending documents.

    A call is repeated until both axes can be read from its answer, with growing pauses; after that all scores are null and the last
    answer, or else the error, stays. Each Python worker keeps ``parallel`` calls under way. ``texts`` may have any other columns.
    """
    asked = pending(texts, done).select("doc_id", prompt(template, max_chars=max_chars).alias("prompt"))

    def one(text: str) -> str:
        answer = error = None
        for k in range(attempts):
            try:
                answer = scorer(text)
                if None not in parse_scores(answer):
                    return answer
            except Exception as e:  # noqa: BLE001
                error = f"error: {e}"
            if k + 1 < attempts and pause:
                time.sleep(pause * (2**k + random.random()))
        return answer if answer is not None else error

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
            for b in batches:
                yield pd.DataFrame({"doc_id": b["doc_id"], "raw_response": list(pool.map(one, b["prompt"]))})

    raw = asked.mapInPandas(call, "doc_id string, raw_response string")
    both = raw.withColumns({"educational_value": parsed_score("raw_response", "educational_value"), "content_quality": parsed_score("raw_response", "content_quality")})
    both = both.withColumn("quality_score", combined_score("educational_value", "content_quality"))
    kept = [F.when(F.col("quality_score").isNotNull(), F.col(c)).alias(c) for c in ("educational_value", "content_quality")]
    return both.select("doc_id", *kept, "quality_score", "raw_response")


def judge_to(texts: DataFrame, template: str, path: str, scorer: Scorer = stub, every: int = 1000, **options) -> DataFrame:
    """:func:`judge`, appended to the table at ``path`` after every ``every`` documents or so; returns the whole table.

    What the table holds is not asked for again, so a run that failed goes on where it stopped and loses ``every`` answers at most.
    A part is a range of id hashes: it is the same set of documents in every run.
    """
    spark = texts.sparkSession
    schema = "doc_id string, educational_value double, content_quality double, quality_score double, raw_response string"
    try:
        held = spark.read.schema(schema).parquet(path)
        held.isEmpty()
    except AnalysisException:
        held = None
    texts = texts.withColumn("doc_id", F.col("doc_id").cast("string"))
    n = pending(texts, held).count()
    parts = max(1, -(-n // every))
    for k in range(parts if n else 0):
        part = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == k)
        judge(part, template, scorer, held, **options).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path) if n or held is not None else spark.createDataFrame([], schema)


def summary(scores: DataFrame) -> DataFrame:
    """``n, failed`` and mean and median of the score and both axes."""
    cols = ("quality_score", "educational_value", "content_quality")
    base = scores.agg(F.count("*").alias("n"), F.count_if(F.col("quality_score").isNull()).alias("failed"), *[F.avg(c).alias(f"mean_{c}") for c in cols])
    long = scores.select(F.inline(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("v")) for c in cols])))
    middle = quantiles(long, "axis", "v", {"m": 0.5}).agg(*[F.max(F.when(F.col("axis") == c, F.col("m"))).alias(f"median_{c}") for c in cols])
    return base.crossJoin(middle).select("n", "failed", *[f"{k}_{c}" for c in cols for k in ("mean", "median")])  # one row each


def human_and_judge(human: DataFrame, scores: DataFrame) -> DataFrame:
    """``doc_id, human, judge, delta``: documents scored by both (canonical ids in bare form), one row a document, the largest of repeated scores."""
    one = lambda d, c, name: d.select(bare_id("doc_id").alias("doc_id"), F.col(c).cast("double").alias(name)).filter(F.col(name).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(name).alias(name))
    both = one(human, "score", "human").join(one(scores, "quality_score", "judge"), "doc_id")
    return both.withColumn("delta", F.col("human") - F.col("judge"))


def disagreements(both: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` documents with the largest and the ``n`` with the smallest delta, with ``side`` (human or judge) and ``place``."""
    out = None
    for side, order in (("human", F.desc("delta")), ("judge", F.asc("delta"))):
        best = both.orderBy(order, "doc_id").limit(n)
        rows = best.withColumns({"side": F.lit(side), "place": F.row_number().over(Window.orderBy(order, "doc_id"))})  # n rows
        out = rows if out is None else out.unionByName(rows)
    return out
