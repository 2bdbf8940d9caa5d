"""The registered queries of the core, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siktverk.functions import clock
from siktverk.functions.domains import FAMILIES, topic_family
from siktverk.functions.ids import bare_id, canonical_id, hash_fraction, hash_split, wrapped_id
from siktverk.functions.judge import combined_score, parsed_score
from siktverk.operators import features as feat
from siktverk.operators import joins, judging, metrics, preference, ranking, sampling, training
from siktverk.operators.ordering import quantiles
from siktverk.plans import views as v
from siktverk.plans.config import Training
from siktverk.sources import readers, sinks
from siktverk.sources.durable import checkpoint_dir, durable
from siktverk.sources.tables import table
from siktverk.streaming import responses as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS = 6
#: A priority other than the even one.
CREDITS = {"content_quality": 30.0, "information_density": 10.0, "educational_value": 30.0, "safety": 5.0, "pii_absence": 5.0, "length": 10.0, "language_confidence": 10.0}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, as in the SQL."""
    return df.select(*[F.round(c, DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    return ranking.prepare(v.joined(spark, d), v.LID)


# Ids, features, filter, statistics, ranking.


@query(f"select match_no, regexp_replace(id, '^<urn:uuid:(.*)>$', '\\1') as canonical, {v.bare('id')} as bare, '<urn:uuid:' || regexp_replace(id, '^<urn:uuid:(.*)>$', '\\1') || '>' as wrapped from matches")
def canonical_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "matches", "match_no", "id").select("match_no", canonical_id("id").alias("canonical"), bare_id("id").alias("bare"), wrapped_id("id").alias("wrapped"))


@query(f"with {v.SQL_ANN}, {v.SQL_META}, {v.SQL_FEAT} select doc_id, {', '.join(feat.FEATURES)}, minhash_cluster_size, duplicate_count from feat")
def ordinal_features(spark: SparkSession, d: str) -> DataFrame:
    return feat.to_features(v.joined(spark, d)).select("doc_id", *feat.FEATURES, "minhash_cluster_size", "duplicate_count")


_TEST = f"full_doc_lid = '{v.LID}' and content_quality >= 2 and length >= 1 and pii_absence = 1"


@query(f"with {v.SQL_ANN}, {v.SQL_META}, {v.SQL_FEAT}, {v.sql_filter(_TEST)} select doc_id, passed_hard_filter from flt")
def hard_filter(spark: SparkSession, d: str) -> DataFrame:
    return feat.hard_filter(feat.to_features(v.joined(spark, d)), v.LID, {"content_quality": 2, "length": 1}, True).select("doc_id", "passed_hard_filter")


@query(f"{v.SQL_BASE} select feature, round(p1, 6) as p1, round(p99, 6) as p99, round(mean, 6) as mean, round(std, 6) as std from stats")
def norm_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = feat.hard_filter(feat.to_features(v.joined(spark, d)), v.LID).filter("passed_hard_filter")
    stats = feat.nearest_rank_stats(rows, list(feat.FEATURES))
    return rounded(spark.createDataFrame([(k, *map(float, (s["p1"], s["p99"], s["mean"], s["std"]))) for k, s in stats.items()], "feature string, p1 double, p99 double, mean double, std double"))


@query(f"{v.SQL_BASE} select doc_id, {', '.join(f'round({f}_z, 6) as {f}_z' for f in feat.FEATURES)} from norm")
def normalized_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_prepared(spark, d).select("doc_id", *[f"{f}_z" for f in feat.FEATURES]))


@query(f"{v.SQL_BASE} select doc_id, round(inverted_cluster_size, 6) as inverted_cluster_size, round(inverted_duplicate_count, 6) as inverted_duplicate_count from ded")
def dedup_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_prepared(spark, d).select("doc_id", "inverted_cluster_size", "inverted_duplicate_count"))


@query(f"{v.SQL_BASE} select doc_id, " + ", ".join(f"round({f}_z * {CREDITS[f] / 100}::double, 6) as ux_{f}" for f in feat.FEATURES) + " from norm")
def interaction_features(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.prepare(v.joined(spark, d), v.LID, unit={f: c / 100 for f, c in CREDITS.items()})
    return rounded(rows.select("doc_id", *[f"ux_{f}" for f in feat.FEATURES]))


_UNIT = {f: 1 / len(feat.FEATURES) for f in feat.FEATURES}
_OWN = {f: c / 100 for f, c in CREDITS.items()}


@query(f"{v.SQL_BASE}, {v.sql_rank(_UNIT)} select doc_id, round(z_l1, 6) as z_l1, rank_l1 from r1")
def l1_rank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.rank_l1(_prepared(spark, d), unit=_UNIT).select("doc_id", "z_l1", "rank_l1"))


@query(f"{v.SQL_BASE}, {v.sql_rank(_OWN)} select doc_id, round(z_l1, 6) as z_l1, rank_l1 from r1 where passed_hard_filter")
def l1_rank_priorities(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.rank_l1(_prepared(spark, d), unit=_OWN).filter("passed_hard_filter").select("doc_id", "z_l1", "rank_l1"))


_OUT = "select doc_id, passed_hard_filter, rank_l1, round(z_l1, 6) as z_l1, rank_l2, round(score_l2, 6) as score_l2, {top} as in_top_k, round(minhash_cluster_size, 6) as minhash_cluster_size, round(duplicate_count, 6) as duplicate_count from {t}"


@query(f"{v.SQL_BASE}, {v.sql_rank(_UNIT)}, {v.SQL_L2} " + _OUT.format(t="r2", top=f"coalesce(rank_l2 <= {v.K}, false)"))
def rerank_prototype(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.finalize(ranking.rank_l2(ranking.rank_l1(_prepared(spark, d), unit=_UNIT), v.K, v.M)))


@query(f"{v.SQL_BASE}, {v.sql_rank(_UNIT)} " + _OUT.format(t="(select *, null::bigint as rank_l2, null::double as score_l2 from r1)", top=f"coalesce(rank_l1 <= {v.K}, false)"))
def rerank_l2_disabled(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.finalize(ranking.rank_l2(ranking.rank_l1(_prepared(spark, d), unit=_UNIT), v.K, v.M, "disabled")))


@query(f"{v.SQL_BASE}, {v.sql_rank(_UNIT)}, {v.SQL_L2} select count(*) as rows, count_if(passed_hard_filter) as passed, count_if(coalesce(rank_l2 <= {v.K}, false)) as top_k from r2")
def row_totals(spark: SparkSession, d: str) -> DataFrame:
    return ranking.report(ranking.rank_l2(ranking.rank_l1(_prepared(spark, d), unit=_UNIT), v.K, v.M))


# Joins, labels, set operations, sources.



@query("""
with a as (select id, count(*) as na from eyeball group by id), b as (select id, count(*) as nb from matches group by id), j as (select coalesce(na, 0) as na, coalesce(nb, 0) as nb from a full join b using (id))
select cast(sum(na) as bigint) as annotation_rows, cast(sum(nb) as bigint) as metadata_rows, cast(sum(na * nb) as bigint) as matched_rows, count_if(na > 0 and nb = 0) as unmatched_annotations, count_if(nb > 0 and na = 0) as unmatched_metadata from j""")
def join_report(spark: SparkSession, d: str) -> DataFrame:
    return joins.join_report(table(spark, d, "eyeball", "id"), table(spark, d, "matches", "id"))


@query(f"with {v.SQL_ANN}, {v.SQL_META}, {v.SQL_FEAT}, {v.SQL_LABELS} select doc_id, round(gold_score, 6) as gold_score from feat join lab using (doc_id)")
def label_attach(spark: SparkSession, d: str) -> DataFrame:
    return rounded(joins.attach_labels(feat.to_features(v.joined(spark, d)), v.labels(spark, d)).select("doc_id", "gold_score"))


@query(f"with {v.SQL_LABELS} select count(*) as count, round(min(gold_score), 6) as min, round(max(gold_score), 6) as max, round(avg(gold_score), 6) as mean, round(stddev_pop(gold_score), 6) as std, round(quantile_cont(gold_score, 0.25), 6) as q25, round(quantile_cont(gold_score, 0.5), 6) as q50, round(quantile_cont(gold_score, 0.75), 6) as q75 from lab")
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.describe(v.labels(spark, d), "gold_score"))


@query(f"with {v.SQL_LABELS}, h as (select cast(least(floor(gold_score * 8), 7) as bigint) as bin, count(*) as n from lab group by 1) select r.range as bin, coalesce(n, 0) as n from range(8) r left join h on r.range = h.bin")
def relevance_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bin_histogram(v.labels(spark, d), "gold_score")


_U = "('0x' || substr(sha256({0}), 1, 8))::bigint % 10000 / 10000.0::double"


@query(f"with d as (select distinct {v.bare('id')} as id from documents) select id, {_U.format('id')} as fraction, case when {_U.format('id')} < 0.8::double then 'train' when {_U.format('id')} < 0.9::double then 'val' else 'test' end as split from d")
def hash_splits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "id").select(bare_id("id").alias("id")).distinct().select("id", hash_fraction("id").alias("fraction"), hash_split("id").alias("split"))


@query(f"select {v.bare('id')} as id, count(*) as n, min(indexed_at) as first_indexed, min_by(match_no, (indexed_at, match_no)) as match_no from matches group by 1")
def dedupe_by_id(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "matches", "match_no", "id", "indexed_at").withColumn("id", bare_id("id"))
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.min("indexed_at").alias("first_indexed"), F.min_by("match_no", F.struct("indexed_at", "match_no")).alias("match_no"))


@query(f"select match_no, id from matches where {v.bare('id')} in (select {v.bare('id')} from eyeball)")
def id_matched_scan(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "eyeball", "id").select(bare_id("id").alias("id")).distinct()
    rows = table(spark, d, "matches", "match_no", "id").withColumns({"raw": F.col("id"), "id": bare_id("id")})
    return readers.scan(rows, ["match_no", "raw"], targets=targets).withColumnRenamed("raw", "id")


@query("with c as (select regexp_replace(doc_id, '^<urn:uuid:(.*)>$', '\\1') as c, doc_id from document_scores), f as (select doc_id as f from c union select c from c union select '<urn:uuid:' || c || '>' from c) select match_no, id from matches where id in (select f from f)")
def lookup_spellings(spark: SparkSession, d: str) -> DataFrame:
    return readers.lookup(table(spark, d, "matches", "match_no", "id"), table(spark, d, "document_scores", "doc_id"))


@query(f"select id, text from (select {v.bare('id')} as id, left(text, 50000) as text, row_number() over (partition by {v.bare('id')} order by id, left(text, 50000)) as rn from eyeball where {v.bare('id')} in (select {v.bare('doc_id')} from document_scores)) where rn = 1")
def first_texts(spark: SparkSession, d: str) -> DataFrame:
    return readers.first_texts(table(spark, d, "eyeball", "id", "text"), table(spark, d, "document_scores", "doc_id"))


@query(f"with {v.SQL_ANN} select id from ann where id not in (select {v.bare('doc_id')} from l1_pairwise where gold_score is not null) and id not in (select {v.bare('doc_a_id')} from pairs) and id not in (select {v.bare('doc_b_id')} from pairs)")
def exclude_ids(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "pairs", "doc_a_id", "doc_b_id")
    return joins.without(v.annotations(spark, d).select("id"), v.labels(spark, d).select("doc_id"), pairs.select(bare_id("doc_a_id").alias("id")), pairs.select(bare_id("doc_b_id").alias("id")))



@query(f"with {v.SQL_LABELS} select doc_id, round(gold_score, 6) as gold_score from lab union all select {v.bare('doc_id')}, round(score, 6) from document_scores")
def union_aligned(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "document_scores", "doc_id", "score").select(bare_id("doc_id").alias("doc_id"), F.col("score").cast("string").alias("gold_score"), F.lit(1).alias("extra"))
    return rounded(joins.aligned_union(v.labels(spark, d), scores))


@query("select coalesce(a.id, b.id) as id, case when a.id is null then 'matches' when b.id is null then 'eyeball' else 'both' end as side from (select distinct " + v.bare("id") + " as id from eyeball) a full join (select distinct " + v.bare("id") + " as id from matches) b using (id)")
def id_sets(spark: SparkSession, d: str) -> DataFrame:
    a, b = (table(spark, d, t, "id").select(bare_id("id").alias("id")).distinct() for t in ("eyeball", "matches"))
    side = lambda x, s: x.withColumn("side", F.lit(s))
    return side(a.intersect(b), "both").unionByName(side(a.subtract(b), "eyeball")).unionByName(side(b.subtract(a), "matches"))


@query(f"with {v.SQL_ANN}, {v.SQL_META} select ann.id as id, cast(null as double) as quality_score, {', '.join(v.LABELS)}, {', '.join(v.METADATA)} from ann left join meta using (id)")
def combined_24col(spark: SparkSession, d: str) -> DataFrame:
    out = v.annotations(spark, d).join(v.metadata(spark, d), "id", "left").withColumn("quality_score", F.lit(None).cast("double"))
    return out.select(*v.COMBINED)


_NAME = "lower(trim(rater_name, ' \t\n\r'))"


@query(f"""with q as (select {_NAME} as rater_name, pair_id, queue_position from responses where rater_name is not null and pair_id is not null and queue_position is not null),
done as (select {_NAME} as rater_name, pair_id from responses where session_num = 1 and rater_name is not null and pair_id is not null)
select rater_name, min(queue_position) as queue_position, arg_min(pair_id, (queue_position, pair_id)) as pair_id from q where not exists (select 1 from done d where d.rater_name = q.rater_name and d.pair_id = q.pair_id) group by 1""")
def next_tasks(spark: SparkSession, d: str) -> DataFrame:
    """What each rater gets next after the first session; pairs with any response, skipped ones too, are done."""
    rows = table(spark, d, "responses", "rater_name", "pair_id", "queue_position", "session_num")
    return preference.next_tasks(rows, rows.filter("session_num = 1"))


@query("select rater_name, pair_id, count(*) as n from (select distinct lower(trim(rater_name)) as rater_name, pair_id from responses) group by all")
def upsert_responses(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "responses", "rater_name", "pair_id", "is_duplicate").withColumn("rater_name", F.lower(F.trim("rater_name")))
    keys = ["rater_name", "pair_id"]
    old = rows.filter("is_duplicate = 0").select(*keys).dropDuplicates(keys)
    return sinks.upsert(old, rows.filter("is_duplicate = 1").select(*keys), keys).groupBy(*keys).agg(F.count("*").alias("n"))


# Evaluation.


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return durable(joins.attach_labels(_prepared(spark, d), v.labels(spark, d)).select("doc_id", "passed_hard_filter", "content_type", "gold_score", *feat.FEATURES, *[f"{f}_z" for f in feat.FEATURES], *[f"ux_{f}" for f in feat.FEATURES], "inverted_cluster_size", "inverted_duplicate_count", "minhash_cluster_size", "duplicate_count"))


_LAB = f"{v.SQL_BASE}, {v.SQL_LABELS}, le as (select ded.*, gold_score, substr(sha256(doc_id), 1, 16) as h, sha256('42:' || doc_id) as hs from ded join lab using (doc_id))"
_METHODS = (
    "bs as (select 'random' as method, doc_id, ('0x' || substr(hs, 1, 8))::bigint / 4294967296.0::double as score, gold_score as gold from le"
    " union all select 'feature_mean', doc_id, round((" + "+".join(["0.0::double", *[f"coalesce({f}_z, 0)" for f in feat.FEATURES]]) + f") / {len(feat.FEATURES)}, 9), gold_score from le"
    " union all select 'edu_first', doc_id, cast(count(*) over () + 1 - row_number() over (order by educational_value desc nulls last, content_quality desc nulls last, safety desc nulls last, h desc) as double), gold_score from le"
    " union all select 'quality_first', doc_id, cast(count(*) over () + 1 - row_number() over (order by content_quality desc nulls last, educational_value desc nulls last, safety desc nulls last, h desc) as double), gold_score from le)"
)


@query(f"{_LAB}, {_METHODS} select method, doc_id, round(score, 6) as score, round(gold, 6) as gold from bs")
def baseline_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(training.baselines(_labelled(spark, d)))


def _sql_bundle() -> str:
    ranks = "rk as (select *, cast(least(floor(gold * 8), 7) as bigint) as rel, row_number() over (partition by method order by score desc, doc_id) as rp, row_number() over (partition by method order by gold desc, doc_id) as rg, count(*) over (partition by method) as n from bs), rk2 as (select *, row_number() over (partition by method order by rel desc, doc_id) as ri from rk)"
    cols = ["method", "max(n) as n", "round(corr(rp, rg), 6) as spearman"]
    for p in (1, 5, 10, 20, 30):
        cut = f"greatest(1, ceil(n * {p} / 100.0::double))"
        cols.append(f"round(count_if(rp <= {cut} and rg <= {cut}) / max({cut}), 6) as recall_{p}")
    for k in (10, 25, 50, 100):
        dcg = lambda r: f"sum(case when {r} <= {k} then (pow(2, rel) - 1) / log2({r} + 1) end)"  # noqa: B023, E731
        cols.append(f"case when max(n) >= {k} then round(case when {dcg('ri')} > 0 then {dcg('rp')} / {dcg('ri')} else 0 end, 6) end as ndcg_{k}")
    return f"{ranks} select {', '.join(cols)} from rk2 group by method"


@query(f"{_LAB}, {_METHODS}, {_sql_bundle()}")
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.bundle(training.baselines(_labelled(spark, d))))


def _axes(spark: SparkSession, d: str) -> DataFrame:
    """Judged (gold) and mean-feature scores of a document, for comparison of two raters of one scale."""
    means = F.col("feature_means")
    rows = table(spark, d, "l1_pairwise", "doc_id", "feature_means", "gold_score").select(bare_id("doc_id").alias("doc_id"), F.col("gold_score").alias("x"), (means["content_quality"] / 4).alias("y"))
    return rows.groupBy("doc_id").agg(F.max("x").alias("x"), F.max("y").alias("y"))


_AXES = f"with ax as (select {v.bare('doc_id')} as doc_id, max(gold_score) as x, max(feature_means.content_quality / 4) as y from l1_pairwise group by 1), b as (select * from ax where x is not null and y is not null)"


@query(f"{_AXES} select count(*) as n, round(corr(x, y), 6) as pearson, round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept from b")
def corr_suite(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.correlations(_axes(spark, d), "x", "y"))


@query(f"{_AXES}, r as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from b) select round(corr(rx, ry), 6) as spearman from r")
def spearman_average(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.spearman_average(_axes(spark, d), "x", "y"))


@query(f"""{_AXES}, c as (select x, y, count(*)::double as n from b group by all),
p as (select sum(case when a.y < b.y then a.n * b.n else 0 end) as con, sum(case when a.y > b.y then a.n * b.n else 0 end) as dis from c a join c b on a.x < b.x),
tx as (select sum(n * (n - 1) / 2) as t from (select sum(n) as n from c group by x)), ty as (select sum(n * (n - 1) / 2) as t from (select sum(n) as n from c group by y)), tot as (select sum(n)::bigint as n, sum(n) * (sum(n) - 1) / 2 as p from c)
select tot.n as n, con as concordant, dis as discordant, tx.t as ties_x, ty.t as ties_y, round((con - dis) / sqrt((tot.p - tx.t) * (tot.p - ty.t)), 6) as tau_b from p, tx, ty, tot""")
def kendall_b(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.kendall_b(_axes(spark, d), "x", "y").drop("p_value"))


@query()
def correlation_tests(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.correlation_tests(_axes(spark, d), "x", "y"))


_POOLED = f"{_AXES}, g as (select case when y >= 0.6 then 'high' when y <= 0.4 then 'low' end as g, x from b), h as (select * from g where g is not null)"
_PHI = "(exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530::double + t * (-0.356563782::double + t * (1.781477937::double + t * (-1.821255978::double + t * 1.330274429::double)))))"


@query(f"""{_POOLED}, r as (select g, x, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0::double as rk from h), k as (select x, count(*)::double as c from h group by x),
s as (select count_if(g = 'high') as n1, count_if(g = 'low') as n2, sum(case when g = 'high' then rk end) - count_if(g = 'high') * (count_if(g = 'high') + 1) / 2.0::double as u from r),
v as (select *, (u - n1 * n2 / 2.0::double - 0.5::double) / sqrt(n1 * n2 / 12.0::double * (n1 + n2 + 1 - (select sum(c * c * c - c) from k) / ((n1 + n2) * (n1 + n2 - 1)::double))) as z from s), w as (select *, 1 / (1 + 0.2316419::double * abs(z)) as t from v)
select n1, n2, u::double as u, round(u / (n1 * n2)::double, 6) as auc, round(case when z >= 0 then {_PHI} else 1 - {_PHI} end, 6) as p_greater from w""")
def auc_mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.mann_whitney(_pooled(spark, d), "g", "high", "low", "x"))


def _pooled(spark: SparkSession, d: str) -> DataFrame:
    return _axes(spark, d).withColumn("g", F.when(F.col("y") >= 0.6, "high").when(F.col("y") <= 0.4, "low"))


@query(f"{_POOLED} select g, count(*) as n, round(avg(x), 6) as mean, round(median(x), 6) as median, round(stddev_samp(x), 6) as std, round(min(x), 6) as min, round(max(x), 6) as max from h group by 1")
def pool_comparison(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.pool_comparison(_pooled(spark, d), "g", "x"))


@query(f"{_POOLED} select round(avg(x) filter (g = 'high') - avg(x) filter (g = 'low'), 6) as gap from h")
def pool_gap(spark: SparkSession, d: str) -> DataFrame:
    """The gap of the pools' means."""
    mean = lambda k: F.avg(F.when(F.col("g") == k, F.col("x")))
    return rounded(_pooled(spark, d).filter("x is not null and g is not null").agg((mean("high") - mean("low")).alias("gap")))


@query(f"{_AXES}, s as (select avg(x - y) as bias, stddev_samp(x - y) as sd from ax) select round(bias, 6) as bias, round(sd, 6) as sd, round(bias - 1.96 * sd, 6) as low, round(bias + 1.96 * sd, 6) as high from s")
def bland_altman(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.bland_altman(_axes(spark, d), "x", "y"))


@query(f"{_AXES}, h as (select cast(least(floor(x * 25), 24) as bigint) as bin, count(*) as n from ax where x between 0 and 1 group by 1) select bin, n, round(n * 25.0 / sum(n) over (), 6) as density from h")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.unit_histogram(_axes(spark, d), "x"))


@query(f"""{_AXES}, k as (select count(*) as n, greatest(1, floor(0.1::double * count(*)))::bigint as k from b),
r as (select doc_id, row_number() over (order by x desc, doc_id) as tx, row_number() over (order by y desc, doc_id) as ty, row_number() over (order by x, doc_id) as bx, row_number() over (order by y, doc_id) as by_ from b),
s as (select n, k, count_if(tx <= k and ty <= k) as t, count_if(bx <= k and by_ <= k) as l from r, k group by all)
select n, k, t as top_overlap, round(t / (2 * k - t)::double, 6) as top_jaccard, l as bottom_overlap, round(l / (2 * k - l)::double, 6) as bottom_jaccard from s""")
def topk_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.topk_overlap(_axes(spark, d), "x", "y"))


# Samples, groups, pools.

_STRATA = f"strata as (select id, {v.sampler('educational_value')} as edu_ord, {v.sampler('content_quality')} as quality_ord from ann)"
_BOTH = ["edu_ord", "quality_ord"]


def _pool(spark: SparkSession, d: str) -> DataFrame:
    return sampling.with_strata(v.annotations(spark, d))


@query(f"with {v.SQL_ANN}, {_STRATA} select edu_ord, quality_ord, count(*) as n from strata where edu_ord is not null and quality_ord is not null group by all")
def stratum_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _pool(spark, d).groupBy(*_BOTH).agg(F.count("*").alias("n"))


_SIZES = f"with {v.SQL_ANN}, {_STRATA}, sz as (select edu_ord, quality_ord, count(*) as n from strata where edu_ord is not null and quality_ord is not null group by all), w as (select *, least(100, sum(n) over ()) as w from sz)"
_EVEN = "a as (select *, row_number() over (order by n, edu_ord, quality_ord) as i, (w - (sum(n) over (order by n, edu_ord, quality_ord) - n)) // (count(*) over () - row_number() over (order by n, edu_ord, quality_ord) + 1) as share from w), l as (select arg_min(share, i) filter (n > share) as level from a), g as (select a.*, least(n, coalesce(level, n)) as base from a, l), al as (select edu_ord, quality_ord, n, base + (n > base and sum((n > base)::int) over (order by edu_ord, quality_ord) <= w - sum(base) over ())::int as given from g)"
_FAIR = "a as (select *, least(2, n) as f from w), b as (select *, greatest(0, least(f, w - sum(f) over (order by n desc, edu_ord, quality_ord) + f)) as base from a), c as (select *, n - base as room, w - sum(base) over () as rest from b), e as (select *, (rest * room) // greatest(sum(room) over (), 1) as part, (rest * room) % greatest(sum(room) over (), 1) as frac from c), al as (select edu_ord, quality_ord, n, base + part + (row_number() over (order by frac desc, n desc, edu_ord, quality_ord) <= rest - sum(part) over ())::int as given from e)"
_STATS = "st as (select edu_ord, quality_ord, n as pool_size, given::bigint as sampled, n / (sum(n) over ())::double as pop_frac, given / (sum(given) over ())::double as sample_frac, n / (sum(n) over ())::double / nullif(given / (sum(given) over ())::double, 0) as stratum_weight from al)"
_STAT = "select edu_ord, quality_ord, pool_size, sampled, round(pop_frac, 6) as pop_frac, round(sample_frac, 6) as sample_frac, round(stratum_weight, 6) as stratum_weight from st"


@query(f"{_SIZES}, {_EVEN}, {_STATS} {_STAT}")
def alloc_uniform(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sampling.stratum_stats(_pool(spark, d), _BOTH, 100))


@query(f"{_SIZES}, {_FAIR}, {_STATS} {_STAT}")
def alloc_proportional(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sampling.stratum_stats(_pool(spark, d), _BOTH, 100, "proportional"))


@query(f"{_SIZES}, {_EVEN}, {_STATS}, rk as (select ann.id, s.edu_ord, s.quality_ord, content_type, row_number() over (partition by s.edu_ord, s.quality_ord order by sha256('42:' || ann.id), ann.id) as k from ann join strata s on s.id = ann.id where s.edu_ord is not null and s.quality_ord is not null) select id, edu_ord, quality_ord, round(stratum_weight, 6) as stratum_weight, content_type from rk join st using (edu_ord, quality_ord) where k <= sampled")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sinks.manifest(sampling.stratified_sample(_pool(spark, d), _BOTH, 100).select("id", *_BOTH, "stratum_weight", "content_type"), ["id", *_BOTH, "stratum_weight"]))


@query(f"with {v.SQL_ANN}, c as (select content_quality || '×' || educational_value as stratum, count(*) as n from ann where content_quality is not null and educational_value is not null group by 1), t as (select *, round_even(n * 300 / (sum(n) over ())::double, 0) as w from c) select stratum, n, cast(case when n < 5 then n else least(n, greatest(5, least(25, w))) end as bigint) as take from t")
def eyeball_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = v.annotations(spark, d).filter("content_quality is not null and educational_value is not null")
    return sampling.eyeball_sizes(rows.withColumn("stratum", F.concat_ws("×", "content_quality", "educational_value")), "stratum")


_POOLS = f"pools as (select id, case when {v.sampler('educational_value')} >= 3 and {v.sampler('content_quality')} >= 3 and content_ratio = 'complete_content' and content_safety = 'safe' and pii_presence = 'no_pii' then 'top' when {v.sampler('educational_value')} <= 1 and {v.sampler('content_quality')} <= 2 and content_ratio in ('mostly_navigation', 'minimal_content', 'mixed_content') then 'bottom' end as pool from ann)"


@query(f"with {v.SQL_ANN}, {_POOLS} select id, pool from pools where pool is not null")
def extreme_pools(spark: SparkSession, d: str) -> DataFrame:
    return sampling.extreme_pool(v.annotations(spark, d)).filter("pool is not null").select("id", "pool")


@query(f"with {v.SQL_ANN}, {_POOLS}, {v.SQL_LABELS} select id, pool, round(gold_score, 6) as gold_score from pools join ann using (id) join lab on lab.doc_id = id where pool = 'top' and {v.sampler('educational_value')} = 4 and {v.sampler('content_quality')} = 4 or pool = 'bottom' and {v.sampler('educational_value')} <= 1 and {v.sampler('content_quality')} <= 1")
def strict_training(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the pools that are extreme on both axes, with the judged score as label."""
    judged = v.labels(spark, d).select(F.col("doc_id").alias("id"), F.col("gold_score").alias("llm_content_quality"))
    rows = sampling.extreme_pool(v.annotations(spark, d)).filter("pool is not null").join(judged, "id")
    return rounded(sampling.strict_training(rows).select("id", "pool", "gold_score"))


@query(f"with {v.SQL_ANN}, {_POOLS} select id, pool from (select *, row_number() over (partition by pool order by sha256('42:' || id), id) as rn from pools where pool is not null) where rn <= 20")
def pool_samples(spark: SparkSession, d: str) -> DataFrame:
    return sampling.pool_sample(sampling.extreme_pool(v.annotations(spark, d)), "pool", 20).select("id", "pool")



@query(f"with {v.SQL_ANN}, {v.SQL_META}, {v.SQL_FEAT}, k as (select content_type, length from feat where content_type is not null and length is not null group by all having count(*) >= 2), g as (select feat.content_type, feat.length, doc_id, cast(i.range as int) as grp, row_number() over (partition by feat.content_type, feat.length, i.range order by sha256('42:' || i.range || ':' || doc_id), doc_id) as rn from feat join k using (content_type, length), range(32) i) select content_type, length, grp as \"group\", doc_id from g where rn <= 64")
def train_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = feat.to_features(v.joined(spark, d)).select("content_type", "length", "doc_id")
    return sampling.training_groups(rows, ["content_type", "length"]).select("content_type", "length", "group", "doc_id")


@query(f"with {v.SQL_ANN} select case " + " ".join(f"when content_type in {t} then '{k}'" for k, t in FAMILIES.items()) + " else 'informational' end as family, count(*) as n from ann group by 1")
def topic_families(spark: SparkSession, d: str) -> DataFrame:
    return v.annotations(spark, d).groupBy(topic_family("content_type").alias("family")).agg(F.count("*").alias("n"))


def _families(spark: SparkSession, d: str) -> DataFrame:
    rows = v.annotations(spark, d).withColumn("family", topic_family("content_type"))
    bucket = F.create_map(*[F.lit(x) for k, n in (("minimal", 0), ("brief", 1), ("moderate", 2), ("substantial", 3)) for x in (k, n)])
    return rows.withColumn("bucket", F.coalesce(F.try_element_at(bucket, F.col("content_length")), F.lit(0)))


_FAM = f"fam as (select *, case " + " ".join(f"when content_type in {t} then '{k}'" for k, t in FAMILIES.items()) + " else 'informational' end as family, case content_length when 'brief' then 1 when 'moderate' then 2 when 'substantial' then 3 else 0 end as bucket from ann)"


@query(f"with {v.SQL_ANN}, {_FAM}, c as (select family, bucket, count(*) as n from fam where id is not null group by all), m as (select a.family, a.bucket, string_agg(b.bucket::varchar, ',' order by b.bucket) as meets, sum(b.n)::bigint - 1 as partners from c a join c b on a.family = b.family and abs(a.bucket - b.bucket) <= 1 group by all) select family, bucket, id, meets, partners from fam join m using (family, bucket) where id is not null")
def pair_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = joins.band_classes(_families(spark, d), "family", "bucket", "id")
    return rows.withColumn("meets", F.array_join(F.col("meets").cast("array<string>"), ","))


@query()
def pair_capped(spark: SparkSession, d: str) -> DataFrame:
    return sampling.drawn_pairs(_families(spark, d), "family", "bucket", "id")


def _sql_matched(name: str, worse: str, better: str, n: int, seed: int, kind: str) -> str:
    h = f"sha256('{seed}:' || id)"
    return f"""{name}_l as (select id as a, family, row_number() over (partition by family order by {h}, id) as i, {h} as h from fam where {worse} qualify i <= {n}),
{name}_h as (select id as b, family, row_number() over (partition by family order by {h}, id) as i from fam where ({better}) and not coalesce({worse}, false) qualify i <= {n}),
{name}_s as (select a, b, true as same_family, h from {name}_l join {name}_h using (family, i)),
{name}_x as (select a, h, row_number() over (order by h) as i from {name}_l where a not in (select a from {name}_s)), {name}_y as (select b, row_number() over (order by b) as i from {name}_h where b not in (select b from {name}_s)),
{name} as (select a, b, same_family, '{kind}' as pair_kind, 'b' as calibration_correct_doc from (select * from {name}_s union all select a, b, false, h from {name}_x join {name}_y using (i)) order by same_family desc, h, a limit {n})"""


_WHOLE = "content_integrity = 'complete'"
_CALIBRATION = f"{_sql_matched('cr', "content_integrity in ('severely_degraded', 'fragment')", f"{_WHOLE} and content_quality in ('good', 'excellent') and information_density = 'dense'", 5, 42, 'calibration_readability')}, {_sql_matched('cs', f"({_WHOLE} and educational_value in ('none', 'minimal'))", f"{_WHOLE} and educational_value = 'high'", 4, 43, 'calibration_substance')}"


@query(f"with {v.SQL_ANN}, {_FAM}, {_CALIBRATION} select * from cr union all select * from cs")
def calibration_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _families(spark, d)
    whole = F.col("content_integrity") == "complete"
    read = sampling.matched_calibration(rows, F.col("content_integrity").isin("severely_degraded", "fragment"), whole & F.col("content_quality").isin("good", "excellent") & (F.col("information_density") == "dense"), "family", 5, 42)
    sub = sampling.matched_calibration(rows, whole & F.col("educational_value").isin("none", "minimal"), whole & (F.col("educational_value") == "high"), "family", 4, 43)
    return read.withColumn("pair_kind", F.lit("calibration_readability")).unionByName(sub.withColumn("pair_kind", F.lit("calibration_substance"))).withColumn("calibration_correct_doc", F.lit("b"))


#: What a rater is shown of a document, beside its id.
_SHOWN = ["text", "one_sentence_description", "char_count", "content_length", "url", *[c for c in v.LABELS if c not in ("one_sentence_description", "content_length")]]


def _real_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The real pairs of the study by document, each once."""
    return preference.unique_pairs(table(spark, d, "pairs")).filter("pair_kind = 'real' and doc_a_id is not null and doc_b_id is not null").select(F.col("doc_a_id").alias("a"), F.col("doc_b_id").alias("b")).distinct()


_REAL = f"up as (select pair_id, min({v.bare('doc_a_id')}) as a, min({v.bare('doc_b_id')}) as b, min(pair_kind) as pair_kind from pairs group by 1), rp as (select distinct a, b from up where pair_kind = 'real' and a is not null and b is not null)"
_UUID = "(select substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12) from (select sha256('real|' || p.a || '|' || p.b) as h))"


@query(f"with {_REAL} select a, b, row_number() over (order by sha256('42:' || a || '|' || b), a, b) <= 9 as is_duplicate from rp")
def duplicate_marks(spark: SparkSession, d: str) -> DataFrame:
    return sampling.mark_duplicates(_real_pairs(spark, d))


@query(f"with {v.SQL_ANN_WIDE}, {_REAL}, p as (select a, b, row_number() over (order by sha256('42:' || a || '|' || b), a, b) <= 9 as is_duplicate from rp) select 'real' as pair_kind, is_duplicate, {_UUID} as pair_id, " + ", ".join(f"p.{x} as doc_{x}_id, " + ", ".join(f"coalesce(d{x}.{c}, '') as doc_{x}_{c}" if c in ("text", "url") else f"d{x}.{c} as doc_{x}_{c}" for c in _SHOWN) for x in "ab") + " from p join ann da on da.id = p.a join ann db on db.id = p.b")
def pair_table(spark: SparkSession, d: str) -> DataFrame:
    """The real pairs as raters are shown them."""
    pairs = sampling.mark_duplicates(_real_pairs(spark, d)).withColumn("pair_kind", F.lit("real"))
    out = sampling.pair_rows(pairs, v.annotations(spark, d, "text", "char_count", "url"), _SHOWN)
    return out.select("pair_kind", "is_duplicate", "pair_id", *[f"doc_{x}_{c}" for x in "ab" for c in ("id", *_SHOWN)])


@query(f"with {_REAL}, u as (select x, count(*) as u from (select a as x from rp union all select b from rp) group by 1), s as (select list(u order by u) as l, max(u) as m from u) select len(l) as distinct_documents, l[(len(l) * 0.5::double)::bigint + 1] as median_uses, l[floor(len(l) * 0.9::double)::bigint + 1] as p90_uses, m as max_uses from s")
def document_reuse(spark: SparkSession, d: str) -> DataFrame:
    return sampling.reuse(_real_pairs(spark, d))


@query("""with once as (select pair_id, min(pair_kind) as pair_kind, max(is_duplicate) as is_duplicate from pairs group by 1), o as (select *, sha256('42:' || pair_id) as h, sha256('rater-1:' || pair_id) as own from once),
pl as (select pair_id, own from (select *, row_number() over (order by h, pair_id) as i from o where pair_kind = 'real' and not is_duplicate) where i <= 30),
re as (select pair_id, own from (select *, row_number() over (order by h, pair_id) as i from o where pair_kind = 'real' and is_duplicate) where i <= 6),
ca as (select pair_id, own, row_number() over (order by own, pair_id) as i from o where pair_kind <> 'real' qualify i <= 9),
rest as (select *, row_number() over (order by own, pair_id) as i from (select * from pl union all select * from re)),
fr as (select range as p, row_number() over (order by range) as i from range(45) where range not in (0, 7, 14, 15, 22, 29, 30, 37, 44)),
q as (select pair_id, own, [0, 7, 14, 15, 22, 29, 30, 37, 44][i]::int as queue_position from ca union all select pair_id, own, p::int from rest join fr using (i))
select 'rater-1' as rater_name, queue_position, ceil((queue_position + 1) / 15.0::double)::int as session_num, pair_id, case when substr(own, 1, 1) < '8' then 'a_left' else 'a_right' end as side_assignment from q""")
def queue_assignment(spark: SparkSession, d: str) -> DataFrame:
    return sampling.rater_queue(table(spark, d, "pairs", "pair_id", "pair_kind", "is_duplicate"), "rater-1", 0)


@query(f"with {v.SQL_ANN} select content_quality, count(*) as n, round(quantile_cont(length(text), 0.5), 6) as median_chars, round(quantile_cont(length(text), 0.9), 6) as p90_chars from ann where text is not null group by 1")
def char_stats_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    rows = v.annotations(spark, d, "text").filter("text is not null").select("content_quality", F.length("text").alias("c"))
    middle = quantiles(rows, "content_quality", "c", {"median_chars": 0.5, "p90_chars": 0.9}).withColumnRenamed("content_quality", "_q")
    sizes = rows.groupBy("content_quality").agg(F.count("*").alias("n"))
    return rounded(sizes.join(middle, F.col("content_quality").eqNullSafe(F.col("_q"))).drop("_q"))


@query("select doc_id, round(length(regexp_replace(text, '[^\\p{Latin}]', '', 'g')) / nullif(length(regexp_replace(text, '[^\\p{L}]', '', 'g')), 0)::double, 6) as latin_share from documents")
def latin_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table(spark, d, "documents", "doc_id", "text").select("doc_id", metrics.latin_share("text").alias("latin_share")))


# Preferences.

_CLEAN = "r as (select response_id, min(lower(trim(rater_name, ' \t\n\r'))) as rater_name, min(pair_id) as pair_id, min(pair_kind) as pair_kind, min(is_duplicate) as is_duplicate, min(side_assignment) as side_assignment, min(lower(trim(readability_choice, ' \t\n\r'))) as readability_choice, min(lower(trim(substance_choice, ' \t\n\r'))) as substance_choice, min(skipped) <> 0 as skipped, min(time_ms) as time_ms from responses group by response_id)"
_PAIRS = f"p as (select pair_id, min({v.bare('doc_a_id')}) as doc_a_id, min({v.bare('doc_b_id')}) as doc_b_id, min(doc_a_content_quality) as aq, min(doc_b_content_quality) as bq, min(doc_a_educational_value) as ae, min(doc_b_educational_value) as be, min(calibration_correct_doc) as correct from pairs group by pair_id)"


def _pick(c: str) -> str:
    return f"case when {c} is not null then case when starts_with({c}, 'a_') = (side_assignment = 'a_left') then 'a' else 'b' end end"


def _class(pick: str, a: str, b: str, domain: str) -> str:
    x, y = (v.mapped(v.label(c), v.SAMPLER[domain]) for c in (a, b))
    return f"case when {pick} is null then 'missing' when ({x}) is null or ({y}) is null then 'unknown' when ({x}) = ({y}) then 'tie' when ({pick} = 'a') = (({x}) > ({y})) then 'agree' else 'disagree' end"


_RATED = f"with {_CLEAN}, {_PAIRS}, q as (select r.*, p.* exclude (pair_id), {_pick('readability_choice')} as chosen_read_doc, {_pick('substance_choice')} as chosen_sub_doc from r join p using (pair_id) where pair_kind = 'real' and not skipped), t as (select *, {_class('chosen_read_doc', 'aq', 'bq', 'content_quality')} as readability_agr, {_class('chosen_sub_doc', 'ae', 'be', 'educational_value')} as substance_agr, readability_choice is not null and substance_choice is not null as both_answered, coalesce(left(readability_choice, 1) <> left(substance_choice, 1), false) as axes_diverged from q)"


def _rated(spark: SparkSession, d: str) -> DataFrame:
    return preference.rated(table(spark, d, "responses"), table(spark, d, "pairs"))


@query(f"{_RATED} select response_id, rater_name, pair_id, chosen_read_doc, chosen_sub_doc, readability_agr, substance_agr, axes_diverged from t")
def unblind(spark: SparkSession, d: str) -> DataFrame:
    return _rated(spark, d).select("response_id", "rater_name", "pair_id", "chosen_read_doc", "chosen_sub_doc", "readability_agr", "substance_agr", "axes_diverged")


_RATES = "count_if(agr = 'agree') as agree, count_if(agr = 'disagree') as disagree, count_if(agr = 'tie') as tie, count_if(agr = 'unknown') as unknown, count_if(agr = 'missing') as missing, round(count_if(agr = 'agree') / nullif(count_if(agr in ('agree', 'disagree')), 0)::double, 6) as rate"
_LONG = "l as (select rater_name, 'readability' as axis, readability_agr as agr from t union all select rater_name, 'substance', substance_agr from t)"


@query(f"{_RATED}, {_LONG} select axis, {_RATES} from l group by axis")
def agreement_rates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(preference.agreement_rates(_rated(spark, d)))


@query(f"{_RATED}, {_LONG} select rater_name, axis, {_RATES} from l group by all")
def agreement_by_rater(spark: SparkSession, d: str) -> DataFrame:
    return rounded(preference.agreement_rates(_rated(spark, d), "rater_name"))


@query(f"{_RATED} select rater_name, count_if(both_answered) as answered, count_if(axes_diverged) as diverged, round(count_if(axes_diverged) / nullif(count_if(both_answered), 0)::double, 6) as rate from t group by 1")
def separability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(preference.separability(_rated(spark, d), "rater_name"))


@query(f"""with {_CLEAN}, lo as (select pair_id, rater_name, 'readability' as axis, readability_choice as c, side_assignment from r where pair_kind = 'real' and is_duplicate = 1 and not skipped union all select pair_id, rater_name, 'substance', substance_choice, side_assignment from r where pair_kind = 'real' and is_duplicate = 1 and not skipped),
o as (select axis, pair_id, rater_name, max(({_pick('c')}, {_pick('c')} || split_part(c, '_', 2))) as v from lo where c is not null group by all), s as (select axis, pair_id, rater_name, v[1] as doc, v[2] as ex from o)
select a.axis, count(*) as rater_pairs, count_if(a.doc = b.doc) as same_document, count_if(a.ex = b.ex) as same_choice, round(avg((a.doc = b.doc)::int), 6) as binary_rate, round(avg((a.ex = b.ex)::int), 6) as exact_rate from s a join s b on a.axis = b.axis and a.pair_id = b.pair_id and a.rater_name < b.rater_name group by 1""")
def inter_rater(spark: SparkSession, d: str) -> DataFrame:
    return rounded(preference.inter_rater(table(spark, d, "responses")).filter("rater_pairs > 0"))


@query(f"with {_CLEAN} select rater_name, count(*) as n, round(quantile_cont(time_ms, 0.5), 6) as median_ms, round(quantile_cont(time_ms, 0.9), 6) as p90_ms, min(time_ms) as min_ms, max(time_ms) as max_ms from r where not skipped and time_ms is not null group by 1")
def timing_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(preference.timing(table(spark, d, "responses")))


_CAL = f"c as (select *, case when pair_kind = 'calibration_readability' then readability_choice else substance_choice end as ch from r where pair_kind <> 'real' and not skipped), k as (select rater_name, pair_kind, {_pick('ch')} as pick, correct from c join p using (pair_id) where correct is not null)"


@query(f"with {_CLEAN}, {_PAIRS}, {_CAL} select rater_name, pair_kind, count_if(pick = correct) as correct, count(*) as total, round(count_if(pick = correct) / count(*)::double, 6) as accuracy from k where pick is not null group by 1, 2")
def calibration_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(preference.calibration(table(spark, d, "responses"), table(spark, d, "pairs")))


@query("select response_id, ceil((queue_position + 1) / 15.0::double)::int as session, ceil((queue_position + 1) / 15.0::double)::int = session_num as as_stored from responses where queue_position is not null")
def session_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "responses", "response_id", "queue_position", "session_num").filter("queue_position is not null")
    return rows.select("response_id", sampling.session("queue_position").alias("session"), (sampling.session("queue_position") == F.col("session_num")).alias("as_stored"))


@query("select response_id, round(epoch(submitted_at::timestamp) - epoch(first_at), 3) as seconds from (select response_id, submitted_at, min(submitted_at::timestamp) over (partition by lower(trim(rater_name))) as first_at from responses where submitted_at is not null and rater_name is not null)")
def elapsed_times(spark: SparkSession, d: str) -> DataFrame:
    """Seconds from a rater's first answer to each answer."""
    rows = table(spark, d, "responses", "response_id", "rater_name", "submitted_at").filter("submitted_at is not null and rater_name is not null").withColumn("r", F.lower(F.trim("rater_name")))
    first = rows.groupBy("r").agg(F.min(clock.parsed_time("submitted_at")).alias("first_at"))
    return rows.join(first, "r").select("response_id", F.round(clock.elapsed_seconds("first_at", "submitted_at"), 3).alias("seconds"))


_BOARD = ", ".join(f"count_if(not skipped and {a}_choice = '{c}') as {a}_{c}" for a in ("readability", "substance") for c in preference.CHOICES)


@query(f"with {_CLEAN}, {_PAIRS}, {_CAL}, acc as (select rater_name, round(avg((pick = correct)::int) filter (pair_kind = 'calibration_readability'), 6) as cal_read_accuracy, round(avg((pick = correct)::int) filter (pair_kind = 'calibration_substance'), 6) as cal_sub_accuracy from k where pick is not null group by 1), bo as (select rater_name, count(*) as total, count_if(skipped) as skipped, count_if(not r.skipped and pair_kind = 'real' and is_duplicate = 0) as real_count, count_if(not r.skipped and is_duplicate = 1) as repeat_count, count_if(not r.skipped and pair_kind = 'calibration_readability') as cal_read_count, count_if(not r.skipped and pair_kind = 'calibration_substance') as cal_sub_count, round(avg(time_ms) filter (not r.skipped), 6) as mean_time_ms, {_BOARD.replace('not skipped', 'not r.skipped')}, count_if(not r.skipped and readability_choice is not null and substance_choice is not null) as both_answered, count_if(not r.skipped and left(readability_choice, 1) <> left(substance_choice, 1)) as diverged from r group by 1) select bo.*, cal_read_accuracy, cal_sub_accuracy from bo left join acc using (rater_name)")
def rater_dashboard(spark: SparkSession, d: str) -> DataFrame:
    return rounded(preference.dashboard(table(spark, d, "responses"), table(spark, d, "pairs")))


@query(f"with {_CLEAN}, {_PAIRS} select response_id, pair_id, case when side_assignment = 'a_left' then doc_a_id else doc_b_id end as display_a_id, case when side_assignment = 'a_left' then doc_b_id else doc_a_id end as display_b_id from r join p using (pair_id)")
def display_sides(spark: SparkSession, d: str) -> DataFrame:
    return preference.display_sides(table(spark, d, "responses"), table(spark, d, "pairs"))


_WON = f"with {_CLEAN}, {_PAIRS}, b as (select doc_a_id, doc_b_id, {_pick('readability_choice')} as x, {_pick('substance_choice')} as y from r join p using (pair_id) where not skipped and pair_kind = 'real'), k as (select doc_a_id, doc_b_id, x as pick from b where x is not null union all select doc_a_id, doc_b_id, y from b where y is not null), won as (select case when pick = 'a' then doc_a_id else doc_b_id end as winner, case when pick = 'a' then doc_b_id else doc_a_id end as loser from k)"


def _won(spark: SparkSession, d: str) -> DataFrame:
    return preference.outcomes(table(spark, d, "responses"), table(spark, d, "pairs"))


@query(f"{_WON} select winner, loser, count(*) as n from won group by all")
def comparison_edges(spark: SparkSession, d: str) -> DataFrame:
    return preference.edges(_won(spark, d))


@query(f"{_WON} select doc_id, sum(w)::bigint as wins, sum(l)::bigint as losses, count(*) as n_comparisons from (select winner as doc_id, 1 as w, 0 as l from won union all select loser, 0, 1 from won) group by 1")
def win_loss(spark: SparkSession, d: str) -> DataFrame:
    return preference.win_loss(_won(spark, d))


# Plain updates, without extrapolation, until they have long converged.
_BT = (
    _WON.replace("with ", "with recursive ", 1)
    + """, wl as materialized (select doc_id, sum(w)::bigint as wins, sum(1 - w)::bigint as losses, count(*) as n_comparisons from (select winner as doc_id, 1 as w from won union all select loser, 0 from won) group by 1),
ed as materialized (select d, o, sum(n)::double as n from (select winner as d, loser as o, count(*) as n from won where winner <> loser group by all union all select loser, winner, count(*) from won where winner <> loser group by all) group by all),
bt as (select 0 as it, doc_id, 1.0::double as s, 1.0::double as g, count(*) over () as docs from wl
  union all select it + 1, doc_id, new, docs * 0.5 / sum(ghost) over (), docs from (
    select b.it, b.doc_id, b.docs, (w.wins + 0.5) / (coalesce(l.load, 0) + 1 / (b.s + b.g)) as new, 1 / (b.s + b.g) as ghost
    from bt b join wl w using (doc_id) left join (select e.d, sum(e.n / (x.s + y.s)) as load from ed e join bt x on x.doc_id = e.d join bt y on y.doc_id = e.o group by 1) l on l.d = b.doc_id where b.it < 5000)),
lg as (select doc_id, ln(s) as x from bt where it = 5000), ends as (select avg(x) as m, min(x) as lo, max(x) as hi from lg)
select lg.doc_id, round(x - m, 4) as log_odds, round((x - lo) / (hi - lo), 4) as score01, wins, losses, n_comparisons from lg join wl using (doc_id), ends"""
)


@query(_BT)
def bt_scores(spark: SparkSession, d: str) -> DataFrame:
    return preference.bradley_terry(_won(spark, d)).withColumn("score01", F.round("score01", 4))


# The judge.

_ANSWER = """case probe_id % 5 when 0 then '{"educational_value": ' || e || ', "content_quality": ' || q || '}' when 1 then 'Here: {"educational_value": ' || e || ', "content_quality": ' || q || '} thanks' when 2 then 'Educational value: ' || e || chr(10) || 'content_quality = ' || q when 3 then '{"educational_value": ' || e || '}' else 'no score' end"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "rank_probes", "probe_id").withColumns({"e": ((F.col("probe_id") * 7 % 130 - 15) / 100).cast("decimal(5,2)").cast("string"), "q": (F.col("probe_id") * 11 % 101 / 100).cast("decimal(5,2)").cast("string")})
    return rows.select("probe_id", F.expr(_ANSWER).alias("raw"))



def _score(axis: str) -> str:
    found = f"regexp_extract(raw, '(?i){axis.replace('_', '[_\\s]*')}[''\"]?\\s*[:=]\\s*(-?\\d+(?:\\.\\d+)?)', 1)"
    return f"case when {found} <> '' then greatest(least(try_cast({found} as double), 1.0::double), 0.0::double) end"


_PARSED = f"with a as (select probe_id, cast((probe_id * 7 % 130 - 15) / 100.0 as decimal(5,2))::varchar as e, cast(probe_id * 11 % 101 / 100.0 as decimal(5,2))::varchar as q from rank_probes), w as (select probe_id, {_ANSWER} as raw from a), s as (select probe_id, {_score('educational_value')} as educational_value, {_score('content_quality')} as content_quality from w)"


@query(f"{_PARSED} select probe_id, round(educational_value, 6) as educational_value, round(content_quality, 6) as content_quality, round((educational_value + content_quality) / 2, 6) as quality_score from s")
def parse_scores(spark: SparkSession, d: str) -> DataFrame:
    s = _answers(spark, d).select("probe_id", parsed_score("raw", "educational_value").alias("educational_value"), parsed_score("raw", "content_quality").alias("content_quality"))
    return rounded(s.withColumn("quality_score", combined_score("educational_value", "content_quality")))


@query("select count(*) as documents, floor(sum(500 + least(coalesce(length(text), 0), 3000)) / 4)::bigint as input_tokens, count(*) * 30 as output_tokens, round(floor(sum(500 + least(coalesce(length(text), 0), 3000)) / 4) / 1e6 * 0.27 + count(*) * 30 / 1e6 * 0.54, 6) as usd from documents")
def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(judging.cost(table(spark, d, "documents", "text"), 500, 0.27, 0.54))


@query(f"with done as (select {v.bare('doc_id')} as i from document_scores) select distinct {v.bare('id')} as doc_id from eyeball where {v.bare('id')} not in (select i from done)")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "eyeball", "id").select(bare_id("id").alias("doc_id")).distinct()
    return judging.pending(texts, table(spark, d, "document_scores", "doc_id").select(bare_id("doc_id").alias("doc_id")))


_STUB = "round(('0x' || substr(h, {0}, 2))::int / 255.0::double, 2)"


@query(f"with q as (select doc_id::varchar as doc_id, sha256('Rate ' || doc_id || ': ' || left(coalesce(text, ''), 3000)) as h from documents), s as (select doc_id, {_STUB.format(1)} as e, {_STUB.format(3)} as c from q) select doc_id, e as educational_value, c as content_quality, round((e + c) / 2, 6) as quality_score, '{{\"educational_value\": ' || e || ', \"content_quality\": ' || c || '}}' as raw_response from s")
def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rounded(judging.judge(texts, "Rate {id}: {text}", pause=0))


@query(f"{_PARSED}, c as (select *, (educational_value + content_quality) / 2 as quality_score from s) select count(*) as n, count_if(quality_score is null) as failed, " + ", ".join(f"round(avg({c}), 6) as mean_{c}, round(median({c}), 6) as median_{c}" for c in ("quality_score", "educational_value", "content_quality")) + " from c")
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    s = _answers(spark, d).select(parsed_score("raw", "educational_value").alias("educational_value"), parsed_score("raw", "content_quality").alias("content_quality"))
    return rounded(judging.summary(s.withColumn("quality_score", combined_score("educational_value", "content_quality"))))


_JUDGED = f"with hu as (select {v.bare('doc_id')} as doc_id, max(score) as human from document_scores where score is not null and doc_id is not null group by 1), ju as (select {v.bare('doc_id')} as doc_id, max(gold_score) as judge from l1_pairwise where gold_score is not null and doc_id is not null group by 1), hj as (select doc_id, human, judge, human - judge as delta from hu join ju using (doc_id))"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return judging.human_and_judge(table(spark, d, "document_scores", "doc_id", "score"), table(spark, d, "l1_pairwise", "doc_id", F.col("gold_score").alias("quality_score")))


@query(f"{_JUDGED} select doc_id, round(human, 6) as human, round(judge, 6) as judge, round(delta, 6) as delta from hj")
def human_and_judge(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_judged(spark, d))


@query(f"{_JUDGED}, t as (select *, row_number() over (order by delta desc, doc_id) as hi, row_number() over (order by delta, doc_id) as lo from hj), u as (select *, 'human' as side, hi::int as place from t where hi <= 5 union all select *, 'judge', lo::int from t where lo <= 5) select doc_id, round(human, 6) as human, round(judge, 6) as judge, round(delta, 6) as delta, side, place from u")
def disagreements(spark: SparkSession, d: str) -> DataFrame:
    return rounded(judging.disagreements(_judged(spark, d)))


_TALLY = f"ta as (select {v.bare('doc_id')} as id, max(score) as score, max(wins) as wins, max(losses) as losses, max(n_comparisons) as n_comparisons from document_scores where doc_id is not null group by 1)"


@query(f"with {v.SQL_ANN}, {v.SQL_META}, {_TALLY} select ann.id as id, content_quality, educational_value, round(score, 6) as score, wins, losses, n_comparisons, {', '.join('meta.' + c for c in v.METADATA)} from ann join ta using (id) left join meta using (id)")
def scored_sample(spark: SparkSession, d: str) -> DataFrame:
    """Annotated documents with their tallies, and metadata where there is any."""
    tally = table(spark, d, "document_scores").withColumn("id", bare_id("doc_id")).filter("id is not null").groupBy("id").agg(*[F.max(c).alias(c) for c in ("score", "wins", "losses", "n_comparisons")])
    rows = v.annotations(spark, d).select("id", "content_quality", "educational_value").join(tally, "id").join(v.metadata(spark, d), "id", "left")
    return rounded(rows.select("id", "content_quality", "educational_value", "score", "wins", "losses", "n_comparisons", *v.METADATA))


@query(f"with {v.SQL_ANN}, tx as (select * from (select {v.bare('id')} as id, left(text, 50000) as text, row_number() over (partition by {v.bare('id')} order by id, left(text, 50000)) as rn from eyeball) where rn = 1) select ann.id as id, ann.content_quality, tx.text as text from ann left join tx using (id)")
def annotated_texts(spark: SparkSession, d: str) -> DataFrame:
    """Annotations with the first text of their document."""
    ids = v.annotations(spark, d).select("id", "content_quality")
    return ids.join(readers.first_texts(table(spark, d, "eyeball", "id", "text"), ids), "id", "left").select("id", "content_quality", "text")


@query(f"{_WON}, wl as (select doc_id, sum(w)::bigint as wins, count(*) as n_comparisons from (select winner as doc_id, 1 as w from won union all select loser, 0 from won) group by 1), sc as (select *, round(wins / n_comparisons::double, 6) as share from wl), h as (select *, 'head' as \"end\" from sc order by share desc nulls last, doc_id limit 10), t as (select *, 'tail' as \"end\" from sc order by share nulls last, doc_id desc limit 10) select * from h union all select * from t")
def score_extremes(spark: SparkSession, d: str) -> DataFrame:
    """The ten documents with the largest and the smallest share of wins."""
    rows = preference.win_loss(_won(spark, d)).select("doc_id", "wins", "n_comparisons", F.round(F.col("wins") / F.col("n_comparisons"), 6).alias("share"))
    return ranking.head_and_tail(rows, "share", "doc_id")


@query()
def table_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of each table's files."""
    return readers.file_sizes(spark, d)


# Trained models and streams.


@query()
def l1_train_grid(spark: SparkSession, d: str) -> DataFrame:
    t = Training()
    _, cells = training.grid_search(_labelled(spark, d), t.alphas, t.gammas, t.percentiles, t.learning_rate, t.epochs, t.max_pairs)
    return rounded(spark.createDataFrame(cells[["cell", "alpha", "gamma", "mean_recall"]], "cell int, alpha double, gamma double, mean_recall double"))


@query()
def l2_lambda_rank(spark: SparkSession, d: str) -> DataFrame:
    ranked = ranking.rank_l1(_labelled(spark, d), unit=_UNIT)
    groups = sampling.training_groups(ranked.filter("passed_hard_filter"), ["content_type", "length"])
    model = training.train_lambda(ranked, groups)
    scored = training.score_lambda(ranked.filter(F.col("rank_l1") <= v.M * v.K), model, "_s")
    return rounded(ranking.finalize(ranking.rank_l2(scored, v.K, v.M, "trained", F.col("_s")), False))


@query("select rater_name, count(*) as answers from (select distinct rater_name, pair_id from responses where submitted_at is not null) group by 1")
def stream_first_answers(spark: SparkSession, d: str) -> DataFrame:
    """Intake of all answers as a bounded stream; the result lies in the checkpoint folder."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = table(spark, d, "responses")
    source.write.parquet(f"{base}/in")
    stream.run_to(stream.first_answers(stream.read_responses(spark, f"{base}/in"), "400 days").select("rater_name", "pair_id", "response_id"), f"{base}/out", f"{base}/state")
    return spark.read.schema("rater_name string, pair_id string, response_id string").parquet(f"{base}/out").groupBy("rater_name").agg(F.count("*").alias("answers"))
