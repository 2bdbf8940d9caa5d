"""The engine's logical tables over the driver's tables, each with the SQL that yields the same rows.

Annotations come from ``eyeball``, metadata from ``matches``, labels from ``l1_pairwise``; every table has one row a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siktverk.functions.domains import PII_ABSENT, PII_PRESENT, RANKER, SAMPLER
from siktverk.functions.ids import bare_id
from siktverk.operators.features import FEATURES
from siktverk.operators.joins import first_per_key, join_metadata, load_labels
from siktverk.operators.ranking import L1_WEIGHTS
from siktverk.sources.tables import table

# Columns of the annotation and the metadata tables.
LABELS = ("content_integrity", "content_ratio", "content_length", "one_sentence_description", "content_type", "business_sector", "technical_content", "information_density", "content_quality", "audience_level", "commercial_bias", "time_sensitivity", "content_safety", "educational_value", "reasoning_indicators", "pii_presence", "regional_relevance", "country_relevance")
METADATA = ("full_doc_lid_score", "duplicate_count", "full_doc_lid", "minhash_cluster_size")
COMBINED = ("id", "quality_score", *LABELS, *METADATA)
LID, K, M = "swe_Latn", 20, 3


def annotations(spark: SparkSession, directory: str, *extra: str) -> DataFrame:
    rows = table(spark, directory, "eyeball", "id", "fetched_at", *LABELS, *extra).withColumnRenamed("id", "raw").withColumn("id", bare_id("raw"))
    return first_per_key(rows, ["id"], "fetched_at", "raw").drop("raw", "fetched_at")


def metadata(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "matches", "id", "match_no", "indexed_at", *METADATA).withColumn("id", bare_id("id"))
    return first_per_key(rows, ["id"], "indexed_at", "match_no").drop("match_no", "indexed_at")


def joined(spark: SparkSession, directory: str) -> DataFrame:
    return join_metadata(annotations(spark, directory), metadata(spark, directory))


def labels(spark: SparkSession, directory: str) -> DataFrame:
    rows = load_labels(table(spark, directory, "l1_pairwise", "doc_id", "gold_score")).withColumn("doc_id", bare_id("doc_id"))
    return rows.filter("gold_score is not null").groupBy("doc_id").agg(F.max("gold_score").alias("gold_score"))


# The same in SQL for DuckDB.


def bare(c: str) -> str:
    return f"regexp_replace(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '^<?urn:uuid:(.*?)>?$', '\\1')"


def label(c: str) -> str:
    return f"lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"


def mapped(c: str, domain: dict[str, int]) -> str:
    return f"case {c} " + " ".join(f"when '{k}' then {v}" for k, v in domain.items()) + " end"


def sampler(c: str) -> str:
    return f"cast({mapped(label(c), SAMPLER[c])} as bigint)"


def clipped(x: str, low: str, high: str) -> str:
    return f"case when {x} is null then null else greatest(least(({x} - {low}) / ({high} - {low}), 1.0::double), 0.0::double) end"


SQL_ANN = f"ann as (select * exclude (rn, raw, fetched_at, url, char_count, text), text from (select * replace ({bare('id')} as id), id as raw, row_number() over (partition by {bare('id')} order by fetched_at, id) as rn from eyeball) where rn = 1)"
SQL_ANN_WIDE = f"ann as (select * exclude (rn, raw, fetched_at) from (select * replace ({bare('id')} as id), id as raw, row_number() over (partition by {bare('id')} order by fetched_at, id) as rn from eyeball) where rn = 1)"
SQL_META = f"meta as (select id, full_doc_lid, full_doc_lid_score, minhash_cluster_size, duplicate_count from (select *  replace ({bare('id')} as id), row_number() over (partition by {bare('id')} order by indexed_at, match_no) as rn from matches) where rn = 1)"
SQL_LABELS = f"lab as (select {bare('doc_id')} as doc_id, max(greatest(least(gold_score, 1.0::double), 0.0::double)) as gold_score from l1_pairwise where gold_score is not null group by 1)"
_SOURCE = {"content_quality": "content_quality", "information_density": "information_density", "educational_value": "educational_value", "safety": "content_safety", "length": "content_length"}
_PII = f"case when lower(pii_presence) in {PII_PRESENT} then 0 when lower(pii_presence) in {PII_ABSENT} then 1 end"
SQL_FEAT = (
    "feat as (select ann.id as doc_id, full_doc_lid, content_type, "
    + ", ".join(f"cast({mapped(f'lower({c})', RANKER[f])} as bigint) as {f}" for f, c in _SOURCE.items())
    + f", cast({_PII} as bigint) as pii_absence, full_doc_lid_score as language_confidence, coalesce(cast(minhash_cluster_size as double), 0) as minhash_cluster_size, coalesce(cast(duplicate_count as double), 0) as duplicate_count from ann join meta using (id))"
)


def sql_filter(test: str = f"full_doc_lid = '{LID}'") -> str:
    return f"flt as (select *, {test} as passed_hard_filter from feat)"


def _stat(name: str, source: str, column: str) -> str:
    pick = lambda q: f"max(case when i = round((n - 1) * {q}::double) then v end)"
    return (
        f"select '{name}' as feature, coalesce({pick(0.01)}, 0) as p1, case when coalesce({pick(0.99)}, 0) <= coalesce({pick(0.01)}, 0) then coalesce({pick(0.01)}, 0) + 1 else {pick(0.99)} end as p99, coalesce(avg(v), 0) as mean, coalesce(nullif(stddev_samp(v), 0), 1) as std "
        f"from (select cast({column} as double) as v, row_number() over (order by {column}) - 1 as i, count(*) over () as n from {source} where {column} is not null)"
    )


SQL_STATS = "stats as (" + " union all ".join(_stat(f, "(select * from flt where passed_hard_filter)", f) for f in FEATURES) + ")"
SQL_Z = "norm as (select flt.*, " + ", ".join(clipped(f"cast({f} as double)", f"s_{f}.p1", f"s_{f}.p99") + f" as {f}_z" for f in FEATURES) + " from flt " + " ".join(f"cross join (select * from stats where feature = '{f}') s_{f}" for f in FEATURES) + ")"
SQL_DEDUP = (
    "logs as (select *, ln(1 + minhash_cluster_size) as lc, ln(1 + duplicate_count) as ld from norm), dstats as ("
    + _stat("lc", "logs", "lc") + " union all " + _stat("ld", "logs", "ld")
    + "), ded as (select logs.*, 1 - " + clipped("lc", "a.p1", "a.p99") + " as inverted_cluster_size, 1 - " + clipped("ld", "b.p1", "b.p99") + " as inverted_duplicate_count from logs cross join (select * from dstats where feature = 'lc') a cross join (select * from dstats where feature = 'ld') b)"
)


def sql_z_l1(unit: dict[str, float] | None = None, mu: float | None = None) -> str:
    mu = 0.0 if unit is None else max(L1_WEIGHTS.values()) if mu is None else mu
    out = "0.0::double"
    for f in FEATURES:
        out = f"({out} + coalesce({f}_z, 0.0) * {L1_WEIGHTS[f] + mu * (unit[f] if unit else 0.0)!r}::double)"
    return f"round({out}, 9)"


def sql_rank(unit: dict[str, float] | None = None) -> str:
    return f"sc as (select *, case when passed_hard_filter then {sql_z_l1(unit)} end as z_l1 from ded), r1 as (select *, case when passed_hard_filter then row_number() over (partition by passed_hard_filter order by z_l1 desc, doc_id) end as rank_l1 from sc)"


SQL_L2 = (
    f"r2a as (select *, case when rank_l1 <= {M * K} then round(z_l1 + 0.35::double * coalesce(inverted_cluster_size, 0) + 0.35::double * coalesce(inverted_duplicate_count, 0), 9) end as score_l2 from r1),"
    f" r2 as (select *, case when rank_l1 <= {M * K} then row_number() over (partition by coalesce(rank_l1 <= {M * K}, false) order by score_l2 desc, doc_id) end as rank_l2 from r2a)"
)
SQL_BASE = f"with {SQL_ANN}, {SQL_META}, {SQL_FEAT}, {sql_filter()}, {SQL_STATS}, {SQL_Z}, {SQL_DEDUP}"
