"""Sources: local tables, fallbacks, id-matched scans, texts with a cache, splits, validated shards, SQL lookups."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siktverk.functions.ids import bare_id, canonical_id, lookup_forms
from siktverk.operators.joins import first_per_key, members

MAX_TEXT = 50_000
_T = TypeVar("_T")


def retried(read: Callable[[], _T], attempts: int = 5, pause: float = 1.0) -> _T:
    """``read()``, up to ``attempts`` times with linearly growing pauses; the last error is raised. For sources that fail now and then."""
    for k in range(1, attempts + 1):
        try:
            return read()
        except Exception:  # noqa: BLE001
            if k == attempts:
                raise
            time.sleep(pause * k)
    raise ValueError("no attempts")


def pool_scan(df: DataFrame, pool_size: int = 100_000) -> DataFrame:
    """The first ``pool_size`` rows with all columns, as a pool to sample from. The limit is the feature."""
    return df.limit(pool_size)


def read_local(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by suffix, else CSV with a header, whose delimiter is ``;`` if the header has more of them than commas."""
    if Path(path).suffix == ".parquet":
        return spark.read.parquet(path)
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    sep = ";" if line.count(";") > line.count(",") else ","
    return spark.read.csv(path, header=True, sep=sep, inferSchema=True, multiLine=True, escape='"')


def open_with_fallback(spark: SparkSession, path: str, config: str | None = None) -> DataFrame:
    """``path/config``, then ``path``; both errors are told if neither opens."""
    errors = []
    for p in [f"{path}/{config}"] * bool(config) + [path]:
        try:
            return read_local(spark, p)
        except Exception as e:  # noqa: BLE001
            errors.append(f"{p}: {str(e).splitlines()[0]}")
    raise FileNotFoundError("; ".join(errors))


def projected(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns asked for, missing ones as null strings."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def scan(df: DataFrame, columns: list[str], limit: int | None = None, targets: DataFrame | None = None, source: str | None = None) -> DataFrame:
    """Projecting scan: the first ``limit`` rows, or with targets all rows of their ids; ``source`` filters ``source_dataset``."""
    if source is not None and "source_dataset" in df.columns:
        df = df.filter(F.col("source_dataset") == source)
    if targets is not None and not targets.isEmpty():
        return projected(members(df, targets), columns)
    out = projected(df, columns)
    return out if limit is None else out.limit(limit)


def first_texts(df: DataFrame, targets: DataFrame, id_column: str = "id", text_column: str = "text", max_scan: int | None = None, path: str | None = None) -> DataFrame:
    """``id, text``: the first row (by raw id and text) of each bare id among the targets, texts cut to 50,000 characters.

    ``max_scan`` reads that many rows only. With a ``path``, what is found is kept there, and targets that stand there already are
    not looked for again.
    """
    if missing := {id_column, text_column} - set(df.columns):
        raise ValueError(f"columns not found: {sorted(missing)}")
    wanted = targets.select(bare_id(targets.columns[0]).alias("id")).distinct()
    if path:
        return fetch_texts(df if max_scan is None else df.limit(max_scan), wanted, path=path)
    rows = (df if max_scan is None else df.limit(max_scan)).select(bare_id(id_column).alias("id"), F.left(text_column, F.lit(MAX_TEXT)).alias("text"), F.col(id_column).alias("_raw")).join(wanted, "id", "left_semi")
    return first_per_key(rows, ["id"], "_raw", "text").select("id", "text")


def fetch_texts(corpus: DataFrame | None, ids: DataFrame, cache: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """``id, text`` of the asked ids: from the cache first, only what it lacks from the corpus; no corpus means the cache alone.

    ``path`` names a cache table, which is read, and to which new texts are appended by Spark's commit protocol: a run that
    fails leaves it as it was.
    """
    wanted = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    if path and cache is None:
        try:
            cache = ids.sparkSession.read.schema("id string, text string").parquet(path)
        except AnalysisException:
            cache = None
    if cache is None:
        if corpus is None:
            return ids.sparkSession.createDataFrame([], "id string, text string")
        found, held = first_texts(corpus, wanted), None
    else:
        held = cache.select("id", "text").join(wanted, "id", "left_semi")
        if corpus is None:
            return held
        found = first_texts(corpus, wanted.join(held.select("id"), "id", "left_anti"))
    if path:
        found.write.mode("append").parquet(path)
        return ids.sparkSession.read.schema("id string, text string").parquet(path).join(wanted, "id", "left_semi")
    return found if held is None else held.unionByName(found)


def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """``name, files, bytes, size``: bytes of the files of each entry of a folder, with ``size`` in human units; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    root = folder.rstrip("/").rsplit("/", 1)[-1]
    name = F.regexp_extract("path", f"/{re.escape(root)}/([^/]+)", 1)
    sizes = files.groupBy(name.alias("name")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    return sizes.withColumn("size", human_bytes(F.col("bytes")))


def human_bytes(c: Column) -> Column:
    """Bytes to one digit in the largest unit of 1,024 that leaves less than 1,024, up to TB."""
    out = F.format_string("%.1f TB", c / 1024.0**4)
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(c < 1024 ** (k + 1), F.format_string(f"%.1f {unit}", c / float(1024**k))).otherwise(out)
    return out


def resolve_split(available: list[str], language: str | None, preferred: tuple[str, ...] = ("swe_Latn", "sv", "train")) -> str:
    """The language asked for, the first preferred one, or the first there is."""
    if not available:
        raise ValueError("no split")
    return next((x for x in (language, *preferred) if x in available), available[0])


def read_shards(spark: SparkSession, paths: list[str], columns: list[str], targets: DataFrame | None = None, id_column: str = "id") -> DataFrame:
    """Column-pruned union of shards, rows of the targets, one a bare id."""
    df = spark.read.parquet(*paths).select(*columns)
    if targets is not None:
        df = members(df, targets, id_column, targets.columns[0])
    return first_per_key(df.withColumn("_norm", bare_id(id_column)), ["_norm"], id_column).drop("_norm")


def validated_shard(df: DataFrame, ids: DataFrame, id_column: str = "id") -> DataFrame:
    """``df``, if it has the id column with the same type and shares an id with ``ids``; else an error."""
    if id_column not in df.columns:
        raise ValueError(f"no column {id_column}")
    other = ids.columns[0]
    if df.schema[id_column].dataType != ids.schema[other].dataType:
        raise TypeError("ids of another type")
    if df.join(ids.select(canonical_id(other).alias("_i")), canonical_id(id_column) == F.col("_i"), "left_semi").isEmpty():
        raise ValueError("no id in common")
    return df


def lookup(df: DataFrame, ids: DataFrame, id_column: str = "id") -> DataFrame:
    """Rows found under any spelling of the ids (raw, bare, wrapped)."""
    forms = ids.select(F.explode(lookup_forms(ids.columns[0])).alias("_f")).distinct()
    return df.join(forms, F.col(id_column) == F.col("_f"), "left_semi")


def next_task(assignments: DataFrame, responses: DataFrame, rater: str) -> DataFrame:
    """The first assigned pair of a rater without an answer: a null-safe anti join, then a top-1."""
    mine = assignments.filter(F.col("rater_name") == rater)
    done = responses.filter((F.col("rater_name") == rater) & F.col("pair_id").isNotNull()).select("pair_id")
    return mine.join(done, "pair_id", "left_anti").orderBy("queue_position").limit(1)


RESPONSES = T.StructType([
    T.StructField(n, t)
    for n, t in (
        ("response_id", T.StringType()), ("rater_name", T.StringType()), ("pair_id", T.StringType()), ("pair_kind", T.StringType()), ("is_duplicate", T.IntegerType()), ("queue_position", T.IntegerType()), ("session_num", T.IntegerType()),
        ("side_assignment", T.StringType()), ("readability_choice", T.StringType()), ("substance_choice", T.StringType()), ("skipped", T.IntegerType()), ("notes", T.StringType()), ("time_ms", T.LongType()), ("submitted_at", T.StringType()),
    )
])
