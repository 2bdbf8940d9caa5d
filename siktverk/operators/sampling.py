"""Strata, allocations, samples, training groups, pairs and queues. Orders come from seeded hashes of ids."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siktverk.functions.domains import SAMPLER, coerced_ordinal, ordinal
from siktverk.functions.ids import named_uuid, seeded_order
from siktverk.operators.joins import band_members
from siktverk.operators.ordering import running_counts


def with_strata(df: DataFrame, id_column: str = "id") -> DataFrame:
    """Adds ``edu_ord, quality_ord``; rows without an id or with an unknown label are dropped."""
    out = df.withColumns({"edu_ord": ordinal("educational_value", SAMPLER["educational_value"], trim=True), "quality_ord": ordinal("content_quality", SAMPLER["content_quality"], trim=True)})
    return out.filter(F.col(id_column).isNotNull() & F.col("edu_ord").isNotNull() & F.col("quality_ord").isNotNull())


def allocation(sizes: DataFrame, strata: list[str], wanted: int, mode: str = "uniform", least: int = 2) -> DataFrame:
    """``strata, n, given``: rows to draw from each stratum of ``sizes`` (``strata, n``), ``wanted`` in all or everything there is.

    ``uniform`` fills all strata to one level, the highest that ``wanted`` allows: with the strata from small to large, the first
    one that is larger than an even share of what the smaller ones leave sets it. Single rows left over go to the first
    strata by key that are not empty yet. ``proportional`` gives ``least`` to each stratum, the largest first, and shares the rest
    by what they have left, whole parts first, then single rows by the largest fraction. Windows are over the strata only.
    """
    whole = Window.partitionBy()
    rows = sizes.withColumn("_w", F.least(F.lit(wanted), F.sum("n").over(whole)))
    if mode == "uniform":
        up = Window.orderBy("n", *strata)
        share = F.floor((F.col("_w") - (F.sum("n").over(up) - F.col("n"))) / (F.count("*").over(whole) - F.row_number().over(up) + 1))
        rows = rows.withColumns({"_share": share, "_at": F.row_number().over(up)})
        level = F.min_by("_share", F.when(F.col("n") > F.col("_share"), F.col("_at"))).over(whole)
        rows = rows.withColumn("_given", F.least("n", F.coalesce(level, F.col("n"))))
        spare = F.col("n") > F.col("_given")
        turn = F.sum(spare.cast("int")).over(Window.orderBy(*strata))
        extra = F.col("_w") - F.sum("_given").over(whole)
        return rows.select(*strata, "n", (F.col("_given") + (spare & (turn <= extra)).cast("int")).cast("bigint").alias("given"))
    down = Window.orderBy(F.desc("n"), *strata)
    rows = rows.withColumn("_first", F.least(F.lit(least), "n"))
    rows = rows.withColumn("_base", F.greatest(F.lit(0), F.least("_first", F.col("_w") - F.sum("_first").over(down) + F.col("_first"))))
    rows = rows.withColumn("_room", F.col("n") - F.col("_base")).withColumn("_left", F.col("_w") - F.sum("_base").over(whole))
    rows = rows.withColumn("_product", F.col("_left") * F.col("_room")).withColumn("_all", F.greatest(F.sum("_room").over(whole), F.lit(1)))
    rows = rows.withColumns({"_part": F.floor(F.col("_product") / F.col("_all")), "_rest": F.col("_product") % F.col("_all")})
    turn = F.row_number().over(Window.orderBy(F.desc("_rest"), F.desc("n"), *strata))
    one = (turn <= F.col("_left") - F.sum("_part").over(whole)).cast("int")
    return rows.select(*strata, "n", (F.col("_base") + F.col("_part") + one).cast("bigint").alias("given"))


def stratum_stats(pool: DataFrame, strata: list[str], wanted: int, mode: str = "uniform") -> DataFrame:
    """Strata, ``pool_size, sampled, pop_frac, sample_frac, stratum_weight`` (null where nothing is drawn), one row a stratum."""
    given = allocation(pool.groupBy(*strata).agg(F.count("*").alias("n")), strata, wanted, mode)
    whole = Window.partitionBy()  # over the strata only
    pop, part = F.col("n") / F.sum("n").over(whole), F.coalesce(F.try_divide("given", F.sum("given").over(whole)), F.lit(0.0))
    out = given.select(*strata, F.col("n").alias("pool_size"), F.col("given").alias("sampled"), pop.alias("pop_frac"), part.alias("sample_frac"))
    return out.withColumn("stratum_weight", F.try_divide("pop_frac", "sample_frac"))


def stratified_sample(pool: DataFrame, strata: list[str], wanted: int, mode: str = "uniform", seed: int = 42, key: str = "id") -> DataFrame:
    """Exactly the allocated rows of each stratum, in seeded hash order, with ``stratum_weight``."""
    stats = F.broadcast(stratum_stats(pool, strata, wanted, mode).select(*strata, "sampled", "stratum_weight"))
    order = Window.partitionBy(*strata).orderBy(seeded_order(key, seed), key)
    most = max((r["m"] or 0 for r in stats.agg(F.max("sampled").alias("m")).collect()), default=0)
    ranked = pool.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most)  # pruned before the shuffle
    return ranked.join(stats, strata).filter("_k <= sampled").drop("_k", "sampled")


def eyeball_sizes(pool: DataFrame, stratum: str, target: int = 300, low: int = 5, high: int = 25) -> DataFrame:
    """``stratum, n, take``: round(target n / N) half to even, between low and high, all of a stratum under low."""
    counts = pool.groupBy(stratum).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    want = F.greatest(F.lit(low), F.least(F.lit(high), F.bround(F.col("n") * target / total, 0)))
    return counts.select(stratum, "n", F.when(F.col("n") < low, F.col("n")).otherwise(F.least("n", want)).cast("bigint").alias("take"))


def extreme_pool(df: DataFrame) -> DataFrame:
    """Adds ``pool``: ``top``, ``bottom`` or null, from the sampler's ordinals and exact labels."""
    edu, cq = ordinal("educational_value", SAMPLER["educational_value"], trim=True), ordinal("content_quality", SAMPLER["content_quality"], trim=True)
    top = (edu >= 3) & (cq >= 3) & (F.col("content_ratio") == "complete_content") & (F.col("content_safety") == "safe") & (F.col("pii_presence") == "no_pii")
    bottom = (edu <= 1) & (cq <= 2) & F.col("content_ratio").isin("mostly_navigation", "minimal_content", "mixed_content")
    return df.withColumn("pool", F.when(top, "top").when(bottom, "bottom"))


def strict_training(df: DataFrame) -> DataFrame:
    """Rows of a pool that are extreme on both axes, with ``gold_score`` from the judge's content axis."""
    edu, cq = coerced_ordinal("educational_value", SAMPLER["educational_value"]), coerced_ordinal("content_quality", SAMPLER["content_quality"])
    keep = (F.col("pool") == "top") & (edu == 4) & (cq == 4) | (F.col("pool") == "bottom") & (edu <= 1) & (cq <= 1)
    return df.filter(keep).withColumn("gold_score", F.col("llm_content_quality"))


def pool_sample(df: DataFrame, pool: str, per_pool: int = 1000, seed: int = 42, key: str = "id") -> DataFrame:
    """Up to ``per_pool`` rows of each pool in seeded order."""
    w = Window.partitionBy(pool).orderBy(seeded_order(key, seed), key)
    return df.filter(F.col(pool).isNotNull()).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= per_pool).drop("_k")


def training_groups(df: DataFrame, buckets: list[str], size: int = 64, groups: int = 32, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """``bucket, group, key``: for every bucket of at least two rows, groups drawn without replacement inside a group."""
    counts = df.groupBy(*buckets).agg(F.count("*").alias("_n")).filter("_n >= 2")
    rows = df.select(*buckets, key).join(counts.select(*buckets), buckets).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("group").cast("string"), F.lit(":"), F.col(key)), 256)
    w = Window.partitionBy(*buckets, "group").orderBy(order, key)
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= size).drop("_k")


def quotas(sizes: dict[str, int], total: int = 99) -> dict[str, int]:
    """Shares of ``total`` in proportion to the sizes, at least 1, largest remainder first, summing to ``total``."""
    whole = sum(sizes.values())
    if not whole:
        return {}
    exact = {k: total * n / whole for k, n in sizes.items()}
    out = {k: max(1, int(x)) for k, x in exact.items()}
    order = sorted(exact, key=lambda k: (int(exact[k]) - exact[k], k))
    i = 0
    while sum(out.values()) < total:
        out[order[i % len(order)]] += 1
        i += 1
    while sum(out.values()) > total:
        big = max(out, key=lambda k: (out[k], k))
        if out[big] == 1:
            break
        out[big] -= 1
    return out


#: Pairs up to which they are listed and shuffled; more are drawn at random, of which a cap of a few never leaves none.
LISTED = 20_000


def _draw(sizes: dict[tuple, int], allowed: list[tuple[tuple, tuple]], wanted: int, used: dict[tuple, int], seen: set, cap: int, r: random.Random) -> list[tuple[tuple, tuple]]:
    """Up to ``wanted`` new pairs of (class, place), uniform over all pairs of the allowed classes; counts them in ``used`` and ``seen``."""
    weights = [sizes[x] * (sizes[x] - 1) // 2 if x == y else sizes[x] * sizes[y] for x, y in allowed]
    out: list[tuple[tuple, tuple]] = []

    def take(a: tuple, b: tuple) -> None:
        a, b = min(a, b), max(a, b)
        if a != b and (a, b) not in seen and used.get(a, 0) < cap and used.get(b, 0) < cap:
            seen.add((a, b))
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            out.append((a, b))

    if sum(weights) <= LISTED:
        every = [((x, i), (y, j)) for x, y in allowed for i in range(sizes[x]) for j in range(i + 1 if x == y else 0, sizes[y])]
        r.shuffle(every)
        for a, b in every:
            if len(out) == wanted:
                break
            take(a, b)
        return out
    for _ in range(1000 * wanted):
        if len(out) == wanted:
            break
        x, y = r.choices(allowed, weights)[0]
        take((x, r.randrange(sizes[x])), (y, r.randrange(sizes[y])))
    return out


def drawn_pairs(df: DataFrame, group: str, band: str, key: str, total: int = 99, cap: int = 5, width: int = 1, seed: int = 42) -> DataFrame:
    """``a, b, group``: ``total`` pairs drawn from all of :func:`band_pairs`, by :func:`quotas` of the groups' sizes.

    No key is in more than ``cap`` pairs. What the groups cannot give is filled from pairs across groups (group null) and within,
    bands as near. The sizes of the classes and at most 2 ``total`` keys of each, the first in seeded order, reach the driver:
    as many as the pairs can name, so the draw is over all rows. ``total`` is for studies, not for the size of the data.
    """
    rows = band_members(df, group, band, key)
    sizes = {(x[group], x[band]): x["n"] for x in rows.groupBy(group, band).agg(F.count("*").alias("n")).collect()}
    w = Window.partitionBy(group, band).orderBy("_h", key)
    first = rows.withColumn("_h", seeded_order(key, seed)).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= 2 * total)
    keys: dict[tuple, list] = {}
    for x in first.select(group, band, key, "_k").orderBy(group, band, "_k").collect():
        keys.setdefault((x[group], x[band]), []).append(x[key])
    r, classes = random.Random(seed), sorted(sizes)
    near = [(x, y) for i, x in enumerate(classes) for y in classes[i:] if abs(x[1] - y[1]) <= width]
    whole: dict[str, int] = {}
    for (g, _), n in sizes.items():
        whole[g] = whole.get(g, 0) + n
    used: dict[tuple, int] = {}
    seen: set = set()
    got: list[tuple[tuple, tuple]] = []
    for g, wanted in sorted(quotas(whole, total).items()):
        got += _draw(sizes, [(x, y) for x, y in near if x[0] == y[0] == g], wanted, used, seen, cap, r)
    got = got[:total]  # more only with more groups than ``total``
    got += _draw(sizes, near, total - len(got), used, seen, cap, r)
    named: dict[tuple, object] = {}  # places are named as they come up, by the next key of their class
    taken: dict[tuple, int] = {}
    out = []
    for pair in got:
        for place in pair:
            if place not in named:
                c = place[0]
                named[place], taken[c] = keys[c][taken.get(c, 0)], taken.get(c, 0) + 1
        a, b = sorted(named[x] for x in pair)
        out.append((a, b, pair[0][0][0] if pair[0][0][0] == pair[1][0][0] else None))
    kinds = dict(rows.dtypes)
    return df.sparkSession.createDataFrame(out, f"a {kinds[key]}, b {kinds[key]}, {group} {kinds[group]}")


def capped_pairs(pairs: DataFrame, cap: int = 5, seed: int = 42) -> DataFrame:
    """Pairs ``a, b`` that are among the first ``cap`` of both of their documents in seeded order, so none is used more often."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("a"), F.lit("|"), F.col("b")), 256)
    base = pairs.withColumn("_h", order)
    wa = Window.partitionBy("_d").orderBy("_h")
    ends = base.select("a", "b", "_h", F.explode(F.array("a", "b")).alias("_d")).withColumn("_k", F.row_number().over(wa)).filter(F.col("_k") <= cap)
    both = ends.groupBy("a", "b").agg(F.count("*").alias("_n")).filter("_n = 2").select("a", "b")
    return pairs.join(both, ["a", "b"])


def mark_duplicates(pairs: DataFrame, n: int = 9, seed: int = 42) -> DataFrame:
    """``pairs`` (``a, b``, once each) with ``is_duplicate``: true for the first ``n`` in seeded order, which are shown again."""
    order = [seeded_order(F.concat_ws("|", "a", "b"), seed), F.col("a"), F.col("b")]
    first = pairs.select("a", "b").orderBy(*order).limit(n).withColumn("is_duplicate", F.lit(True))
    return pairs.join(F.broadcast(first), ["a", "b"], "left").withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))  # n rows


def pair_rows(pairs: DataFrame, documents: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """The table that raters are shown: the columns of ``pairs`` (``a, b, ...``), a ``pair_id``, and both documents' ``fields`` as ``doc_a_*`` and ``doc_b_*``.

    ``text`` and ``url`` are empty strings where null. The id is made from kind and documents, so a repeated run gives the same.
    A pair whose document is unknown is left out.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in ("text", "url") else F.col(c)
    side = lambda x: documents.select(F.col(key).alias(x), F.col(key).alias(f"doc_{x}_id"), *[blank(c).alias(f"doc_{x}_{c}") for c in fields])
    named = F.concat_ws("|", *[c for c in ("pair_kind",) if c in pairs.columns], "a", "b")
    return pairs.withColumn("pair_id", named_uuid(named)).join(side("a"), "a").join(side("b"), "b").drop("a", "b")


def reuse(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row ``distinct_documents, median_uses, p90_uses, max_uses``: how often pairs use a document; percentiles by position floor(q n)."""
    uses = pairs.select(F.explode(F.array(a, b)).alias("d")).filter("d is not null").groupBy("d").agg(F.count("*").alias("u"))
    ranked = running_counts(uses.groupBy(F.lit("all").alias("g"), "u").agg(F.count("*").alias("n")), "g", "u", "n")
    at = lambda q: F.max(F.when((F.col("before") <= F.floor(F.col("total") * F.lit(q))) & (F.floor(F.col("total") * F.lit(q)) < F.col("before") + F.col("n")), F.col("u")))
    return ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("distinct_documents"), at(0.5).alias("median_uses"), at(0.9).alias("p90_uses"), F.max("u").alias("max_uses"))


def matched_calibration(df: DataFrame, worse: Column, better: Column, family: str, n: int, seed: int, key: str = "id") -> DataFrame:
    """``a`` (worse), ``b`` (better), ``same_family``: the i-th worse meets the i-th better of its family, leftovers across families.

    Every document is used once; the first ``n`` pairs by seeded order, same family first. At most ``n`` rows of each side and
    family are looked at.
    """
    order = seeded_order(key, seed)
    w = Window.partitionBy(family).orderBy(order, key)
    low = df.filter(worse).select(F.col(key).alias("a"), family, F.row_number().over(w).alias("_i"), order.alias("_h")).filter(F.col("_i") <= n)
    high = df.filter(better & ~F.coalesce(worse, F.lit(False))).select(F.col(key).alias("b"), family, F.row_number().over(w).alias("_i")).filter(F.col("_i") <= n)
    same = low.join(high, [family, "_i"]).select("a", "b", F.lit(True).alias("same_family"), "_h")
    left = low.join(same.select("a"), "a", "left_anti").withColumn("_i", F.row_number().over(Window.orderBy("_h")))
    right = high.join(same.select("b"), "b", "left_anti").withColumn("_i", F.row_number().over(Window.orderBy("b")))
    rest = left.join(right, "_i").select("a", "b", F.lit(False).alias("same_family"), "_h")
    return same.unionByName(rest).orderBy(F.desc("same_family"), "_h", "a").limit(n).drop("_h")


# Positions of calibration pairs in a rater's queue, and the repeated pairs that each slot sees.
CALIBRATION_AT = (0, 7, 14, 15, 22, 29, 30, 37, 44)
REPEATS = {0: (0, 1, 2, 3, 4, 5), 1: (0, 1, 2, 6, 7, 8), 2: (3, 4, 5, 6, 7, 8)}
QUEUE, PLAIN = 45, 30


def rater_queue(pairs: DataFrame, rater: str, slot: int, seed: int = 42) -> DataFrame:
    """``rater_name, queue_position, session_num, pair_id, side_assignment``: 30 plain, 6 repeated and 9 calibration pairs.

    Raises for a slot beyond the third, as the study has three. A queue has 45 rows, whatever the pool.
    """
    if slot not in REPEATS:
        raise ValueError("this study is full")
    once = pairs.groupBy("pair_id").agg(F.min("pair_kind").alias("pair_kind"), F.max("is_duplicate").alias("is_duplicate"))
    at = lambda s: F.row_number().over(Window.orderBy(seeded_order("pair_id", s), "pair_id")) - 1

    def first(rows: DataFrame, s: int, n: int, skip: int = 0) -> DataFrame:
        top = rows.orderBy(seeded_order("pair_id", s), "pair_id").limit(skip + n)  # bounded before the window
        return top.select("pair_id", at(s).alias("i")).filter(F.col("i") >= skip)

    real = F.col("pair_kind") == "real"
    plain = first(once.filter(real & ~F.col("is_duplicate")), seed, PLAIN, slot * PLAIN).select("pair_id")
    repeats = first(once.filter(real & F.col("is_duplicate")), seed, 9).filter(F.col("i").isin(*REPEATS[slot])).select("pair_id")
    own = F.sha2(F.concat(F.lit(f"{rater}:"), F.col("pair_id")), 256)
    calibration = once.filter(~real).orderBy(own, "pair_id").limit(len(CALIBRATION_AT))
    calibration = calibration.select("pair_id", (F.row_number().over(Window.orderBy(own, "pair_id")) - 1).alias("i"))
    free = [p for p in range(QUEUE) if p not in CALIBRATION_AT]
    place = lambda ps: F.element_at(F.array(*[F.lit(p) for p in ps]), F.col("i").cast("int") + 1)
    rest = plain.unionByName(repeats).select("pair_id", (F.row_number().over(Window.orderBy(own, "pair_id")) - 1).alias("i"))
    queue = calibration.select("pair_id", place(CALIBRATION_AT).alias("queue_position")).unionByName(rest.select("pair_id", place(free).alias("queue_position")))
    side = F.when(F.substring(own, 1, 1) < "8", "a_left").otherwise("a_right")
    return queue.select(F.lit(rater).alias("rater_name"), "queue_position", session("queue_position").alias("session_num"), "pair_id", side.alias("side_assignment"))


def session(position: Column | str) -> Column:
    c = F.col(position) if isinstance(position, str) else position
    return F.ceil((c + 1) / 15).cast("int")
