"""The registered queries of this subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siktverk.llm import bpe, consensus, fusion, leakage, lookalike, overlap, sampling, scans, skill, textstats
from siktverk.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


SCORES = {"length": "feature_means.length", "content_quality": "feature_means.content_quality", "language_confidence": "least(feature_means.language_confidence, 1.0D)"}


def _above(spark: SparkSession, directory: str, ranking: str, ranked: DataFrame, better: str) -> DataFrame:
    """Probes of a ranking whose first document has the better value; ``ranked`` has ``doc_id`` and ``value``."""
    probes = table(spark, directory, "rank_probes", "probe_id", "ranking", "doc_1_id", "doc_2_id").filter(F.col("ranking") == ranking)
    one = ranked.select(F.col("doc_id").alias("doc_1_id"), F.col("value").alias("v1"))
    two = ranked.select(F.col("doc_id").alias("doc_2_id"), F.col("value").alias("v2"))
    return probes.join(one, "doc_1_id").join(two, "doc_2_id").filter(better).select("probe_id")


def _fused(spark: SparkSession, directory: str) -> tuple[DataFrame, fusion.Component]:
    rows = table(spark, directory, "l1_pairwise", "doc_id", "feature_means")
    return fusion.fuse(rows, "doc_id", SCORES, dict.fromkeys(SCORES, 1))


@query
def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    ranked = _fused(spark, directory)[0].select("doc_id", F.col("position").alias("value"))
    return _above(spark, directory, "l1_pairwise", ranked, "v1 < v2")


@query
def p1_ranking(spark: SparkSession, directory: str) -> DataFrame:
    return _fused(spark, directory)[0]


@query
def p1_loadings(spark: SparkSession, directory: str) -> DataFrame:
    """The rank correlations, the chance of them between unrelated scores, and the first component as found and as used."""
    c = _fused(spark, directory)[1]
    names = list(SCORES)
    rows = [(k, float(c.found[i]), float(c.used[i]), c.chance, *[float(x) for x in c.correlations[i]]) for i, k in enumerate(names)]
    return spark.createDataFrame(rows, "score string, found double, used double, chance double, " + ", ".join(f"corr_{k} double" for k in names))


@query
def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return scans.Repair(table(spark, directory, "eyeball", "id", "text")).defects()


@query
def p2_repaired(spark: SparkSession, directory: str) -> DataFrame:
    return scans.Repair(table(spark, directory, "eyeball", "id", "text")).texts()


@query
def p2_corrections(spark: SparkSession, directory: str) -> DataFrame:
    return scans.Repair(table(spark, directory, "eyeball", "id", "text")).corrections


def _sample(spark: SparkSession, directory: str) -> sampling.Sample:
    labels = ["content_quality", "educational_value"]
    return sampling.Sample(table(spark, directory, "eyeball", "id", *labels), table(spark, directory, "sample_targets"), labels)


@query
def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return _sample(spark, directory).report().filter("not met").select("content_quality", "educational_value")


@query
def p3_report(spark: SparkSession, directory: str) -> DataFrame:
    return _sample(spark, directory).report().drop("quota")


@query
def p3_sample(spark: SparkSession, directory: str) -> DataFrame:
    return _sample(spark, directory).draw()


@query
def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return textstats.not_prose(table(spark, directory, "eyeball", "id", "text"))


@query
def p4_statistics(spark: SparkSession, directory: str) -> DataFrame:
    return textstats.quality(textstats.statistics(table(spark, directory, "eyeball", "id", "text")))


def _overlap(spark: SparkSession, directory: str) -> overlap.Overlap:
    return overlap.Overlap(table(spark, directory, "matches", "match_no", "id", "split", "source", "excerpt"))


@query
def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return _overlap(spark, directory).pairs()


@query
def p5_report(spark: SparkSession, directory: str) -> DataFrame:
    return _overlap(spark, directory).report()


def _outcomes(spark: SparkSession, directory: str) -> DataFrame:
    answers = table(spark, directory, "responses", "response_id", "pair_id", "pair_kind", "side_assignment", "substance_choice", "skipped")
    return skill.outcomes(answers, table(spark, directory, "pairs", "pair_id", "pair_kind", "doc_a_id", "doc_b_id"))


@query
def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    ranked = skill.ranking(_outcomes(spark, directory)).select("doc_id", F.col("position").alias("value"))
    return _above(spark, directory, "responses", ranked, "v1 < v2")


@query
def p6_ranking(spark: SparkSession, directory: str) -> DataFrame:
    return skill.ranking(_outcomes(spark, directory))


@query
def p6_outcomes(spark: SparkSession, directory: str) -> DataFrame:
    return _outcomes(spark, directory)


def _answers(spark: SparkSession, directory: str) -> DataFrame:
    return consensus.answers(table(spark, directory, "responses", "response_id", "rater_name", "pair_id", "is_duplicate", "side_assignment", "readability_choice", "skipped"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query
def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    return consensus.unreliable(consensus.Model(_answers(spark, directory)))


@query
def p7_consensus(spark: SparkSession, directory: str) -> DataFrame:
    return _rounded(consensus.Model(_answers(spark, directory)).consensus(), "probability", "agreement")


@query
def p7_reliability(spark: SparkSession, directory: str) -> DataFrame:
    return _rounded(consensus.Model(_answers(spark, directory)).reliability(), "sensitivity", "specificity", "informedness")


@query
def p7_agreement(spark: SparkSession, directory: str) -> DataFrame:
    read = consensus.agreement(_answers(spark, directory))
    return read.select("pairs", "answers", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "alpha")])


@query
def p8_ids(spark: SparkSession, directory: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, directory, "documents", "doc_id", "text"))


@query
def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    return p9_leaks(spark, directory).select("doc_id", "item_id")


@query
def p9_leaks(spark: SparkSession, directory: str) -> DataFrame:
    return leakage.leaks(table(spark, directory, "documents", "doc_id", "text"), table(spark, directory, "eval_items", "item_id", "text"))


@query
def p10_found(spark: SparkSession, directory: str) -> DataFrame:
    return lookalike.look_pairs(table(spark, directory, "documents", "doc_id", "text"))


@query
def p10_canonical(spark: SparkSession, directory: str) -> DataFrame:
    return lookalike.canonical(table(spark, directory, "documents", "doc_id", "text")).select("doc_id", "canonical")


@query
def p10_classes(spark: SparkSession, directory: str) -> DataFrame:
    return lookalike.look_classes(table(spark, directory, "documents", "doc_id", "text"))


# SQL for the queries that SQL can express.
_BARE = "regexp_replace(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '^<?urn:uuid:(.*?)>?$', '\\1')"
_LABEL = "lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'))"

_REPORT = f"""
with docs as (select distinct {_BARE.format("id")} as id, {_LABEL.format("content_quality")} as content_quality, {_LABEL.format("educational_value")} as educational_value from eyeball),
size as (select count(distinct id) // 5 as s from docs),
got as (select content_quality, educational_value, count(*) as n from docs group by all)
select t.content_quality, t.educational_value, cast(t.target_pct as bigint) as target_pct, t.min_rows, coalesce(got.n, 0) as available,
  greatest(cast(t.min_rows as bigint), (t.target_pct * s + 99) // 100) as required,
  coalesce(got.n, 0) >= greatest(t.min_rows, (t.target_pct * s + 99) // 100) as met
from sample_targets t cross join size left join got using (content_quality, educational_value)
"""
# The ranking of unrelated scores, whose loadings are equal, as Bartlett's test finds them in the project's data.
_AVERAGE = "case when {0} is not null then (rank() over (order by {0} nulls last) + (count(*) over (partition by {0}) - 1) / 2.0::double) / (count({0}) over () + 1)::double - 0.5::double end"
_FUSED = f"""
with d as (select {_BARE.format("doc_id")} as doc_id, max(feature_means.length) as a, max(feature_means.content_quality) as b, max(least(feature_means.language_confidence, 1.0::double)) as c from l1_pairwise where doc_id is not null group by 1),
u as (select doc_id, {_AVERAGE.format("a")} as a, {_AVERAGE.format("b")} as b, {_AVERAGE.format("c")} as c from d),
s as (select doc_id, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / sqrt(3.0::double), 12) as projection, (a is null)::int + (b is null)::int + (c is null)::int as missing from u),
r as (select doc_id, projection, missing, row_number() over (order by projection desc, doc_id) as position from s)
"""
SQL["p1_ranking"] = f"{_FUSED} select * from r"
SQL["p1_found"] = f"{_FUSED} select probe_id from rank_probes p join r x on x.doc_id = p.doc_1_id join r y on y.doc_id = p.doc_2_id where p.ranking = 'l1_pairwise' and x.position < y.position"



def _quotas(rounds: int = 6) -> str:
    """Feasible quotas of the targets; each round shares what the one before left over."""
    out = [f"rep as ({_REPORT})", "t as (select *, row_number() over (order by content_quality, educational_value) as i, (select s from size) * (sum(target_pct) over ()) // 100 as wanted from rep)"]
    previous, given = "(select *, 0::bigint as given, target_pct as w, wanted as left_ from t)", "least(available, greatest(min_rows, m))"
    for k in range(rounds):
        share = "case when sum(w) over () > 0 and left_ > 0 then (left_ * w) // (sum(w) over ()) else 0 end"
        rest = "case when sum(w) over () > 0 and left_ > 0 then (left_ * w) % (sum(w) over ()) else 0 end"
        out.append(f"a{k} as (select *, {share} as base, {rest} as frac, sum(w) over () as sw from {previous})")
        out.append(f"b{k} as (select * exclude (base, frac), base + (sw > 0 and left_ > 0 and row_number() over (order by frac desc, i) <= left_ - sum(base) over ())::int as m from a{k})")
        out.append(f"c{k} as (select * exclude (given, w, left_, m, sw), {given} as given from b{k})")
        previous, given = f"(select *, case when available > given then target_pct else 0 end as w, wanted - sum(given) over () as left_ from c{k})", "given + least(available - given, m)"
    return ", ".join(out) + f", quo as (select content_quality, educational_value, given from c{rounds - 1})"


SQL["p3_sample"] = f"""
with docs as (select distinct {_BARE.format("id")} as id, {_LABEL.format("content_quality")} as content_quality, {_LABEL.format("educational_value")} as educational_value from eyeball where id is not null),
size as (select count(distinct id) // 5 as s from docs), {_quotas()},
rk as (select *, row_number() over (partition by content_quality, educational_value order by sha256('7:' || id), id) as k from docs where content_quality is not null and educational_value is not null)
select id, content_quality, educational_value from rk join quo using (content_quality, educational_value) where k <= given
"""

SQL["p3_report"] = _REPORT
SQL["p3_found"] = f"select content_quality, educational_value from ({_REPORT}) where not met"

SQL["p6_outcomes"] = f"""
with said as (
  select response_id, pair_id, max(case when (lower(trim(substance_choice)) like 'a\\_%' escape '\\') = (trim(side_assignment) = 'a_left') then 1 else 0 end) as won
  from responses where skipped = 0 and trim(pair_kind) = 'real' and lower(trim(substance_choice)) in ('a_much', 'a_slight', 'b_slight', 'b_much') group by all),
votes as (select pair_id, sum(won) as a, sum(1 - won) as b from said group by all),
known as (select pair_id, min({_BARE.format("doc_a_id")}) as x, min({_BARE.format("doc_b_id")}) as y from pairs where pair_kind = 'real' group by all)
select least(x, y) as i, greatest(x, y) as j, cast(sum(case when x < y then a else b end) as bigint) as n_ij, cast(sum(case when x < y then b else a end) as bigint) as n_ji
from votes join known using (pair_id) where x <> y group by 1, 2
"""

_TRIM = "lower(trim({0}, ' \t\n\r'))"


def _expectation() -> str:
    """The rounds of expectation-maximisation, one common table each; ``g`` are the answers, ``m`` the last matrices, ``q`` the last posteriors."""
    n, d = consensus.DIAGONAL * consensus.SMOOTHING, (1 + consensus.DIAGONAL) * consensus.SMOOTHING
    said = f"case when (side_assignment = 'a_left') = starts_with({_TRIM.format('readability_choice')}, 'a_') then 1 else 0 end"
    out = [
        f"o as (select pair_id, {_TRIM.format('rater_name')} as rater_name, response_id, max({said} * 2 + (coalesce(is_duplicate, 0) = 0)::int) as code from (select * replace (trim(side_assignment) as side_assignment) from responses)"
        f" where coalesce(skipped, 0) = 0 and {_TRIM.format('readability_choice')} in ('a_much', 'a_slight', 'b_slight', 'b_much') and side_assignment in ('a_left', 'a_right') and pair_id is not null and rater_name is not null and response_id is not null group by all)",
        "g as (select pair_id, rater_name, count_if(code >= 2)::double as a, count_if(code < 2)::double as b, sum(code % 2)::bigint as f from o group by all)",
        "q0 as (select pair_id, sum(a) / sum(a + b) as q from g group by 1)",
    ]
    for k in range(consensus.ROUNDS):
        rate = lambda x, y: f"({x} + {n}::double) / ({x} + {y} + {d}::double)"
        out.append(f"s{k} as materialized (select rater_name, sum(q * a) as aa, sum(q * b) as ab, sum((1 - q) * b) as bb, sum((1 - q) * a) as ba from g join q{k} using (pair_id) group by 1)")
        out.append(f"m{k} as materialized (select rater_name, {rate('aa', 'ab')} as sens, {rate('bb', 'ba')} as spec from s{k})")
        out.append(f"q{k + 1} as materialized (select pair_id, 1 / (1 + exp(-greatest(least(sum(a * ln(sens / (1 - spec)) + b * ln((1 - sens) / spec)), 40), -40))) as q from g join m{k} using (rater_name) group by 1)")
    return "with " + ", ".join(out)


_RATERS = f"select rater_name, (a + b)::bigint as answers, f as first_showings, round(sens, 6) as sensitivity, round(spec, 6) as specificity, round(sens + spec - 1, 6) as informedness from (select rater_name, sum(a) as a, sum(b) as b, sum(f)::bigint as f from g group by 1) join m{consensus.ROUNDS - 1} using (rater_name)"
SQL["p7_reliability"] = f"{_expectation()} {_RATERS}"
SQL["p7_found"] = f"{_expectation()} select rater_name from ({_RATERS}) where informedness < {consensus.LEAST_INFORMED!r}::double and first_showings >= {consensus.LEAST_ANSWERS}"
SQL["p7_consensus"] = (
    f"{_expectation()} select pair_id, case when q >= 0.5 then 'a' else 'b' end as label, round(greatest(q, 1 - q), 6) as probability, (a + b)::bigint as answers, round((case when q >= 0.5 then a else b end) / (a + b), 6) as agreement"
    f" from (select pair_id, sum(a) as a, sum(b) as b from g group by 1) join q{consensus.ROUNDS} using (pair_id)"
)

SQL["p7_agreement"] = """
with once as (
  select pair_id, response_id, max(case when (lower(trim(readability_choice)) like 'a\\_%' escape '\\') = (trim(side_assignment) = 'a_left') then 1 else 0 end) as a
  from responses where skipped = 0 and lower(trim(readability_choice)) in ('a_much', 'a_slight', 'b_slight', 'b_much') group by all),
per as (select pair_id, cast(sum(a) as double) as a, cast(sum(1 - a) as double) as b from once group by all having count(*) >= 2),
s as (select count(*) as pairs, sum(a + b) as n, sum((a * (a - 1) + b * (b - 1)) / (a + b - 1)) as o, sum(a) as a, sum(b) as b from per),
r as (select pairs, cast(n as bigint) as answers, o / n as observed, (a * (a - 1) + b * (b - 1)) / (n * (n - 1)) as expected from s)
select pairs, answers, round(observed, 6) as observed, round(expected, 6) as expected, round((observed - expected) / (1 - expected), 6) as alpha from r
"""
