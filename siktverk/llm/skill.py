"""One ranking from pairwise comparisons (problem 6).

Method: every item has a Gaussian skill; "i beat j" says that the difference of their skills plus noise is positive. The
factors of all outcomes are approximated by Gaussian messages (expectation propagation), updated for all comparisons at
once with damping, and repeated until no mean is moved any more to speak of. Items are ranked by a
conservative lower bound, their mean less two standard deviations.

Equal outcomes of a pair share one message that counts as often as they occur, so the state is one row a pair of items,
whatever the number of votes. A round is one aggregate with map-side combine and one look-up of the two items of each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from siktverk.functions.ids import bare_id
from siktverk.operators.ordering import numbered
from siktverk.sources.durable import Steps, durable

#: Prior standard deviation of a skill, standard deviation of the noise of one performance, damping, and the standard deviations
#: that the lower bound lies under the mean.
PRIOR_SD, NOISE_SD, DAMPING, CAUTION = 1.5, 1.0, 0.8, 2.0
#: Rounds at most, and what the largest change of a message's mean term, by the precision of the item, may be to end before.
ROUNDS, TOLERANCE = 40, 5e-2
#: Items up to which their skills (24 bytes each) are broadcast to the comparisons; beyond, both are shuffled.
BROADCAST_ITEMS = 500_000
# Coefficients of a Chebyshev fit of ln(erfc(x) exp(x^2) / t), t = 1 / (1 + x / 2), from published tables.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)

_MESSAGES = ("ap", "ah", "bp", "bh", "cp", "ch", "dp", "dh")


def outcomes(responses: DataFrame, pairs: DataFrame, choice: str = "substance_choice", kind: str = "real") -> DataFrame:
    """``i, j, n_ij, n_ji``: for each two compared documents (bare ids, ``i < j``), how often i was chosen over j, and j over i.

    Counts answers that were given and not skipped, to pairs of the kind asked for, once for each ``response_id``. Nulls
    in a needed column, unknown pairs and pairs of a document with itself are left out.
    """
    said = F.lower(F.trim(F.col(choice)))
    left = F.when(F.trim("side_assignment") == "a_left", said.startswith("a_")).when(F.trim("side_assignment") == "a_right", said.startswith("b_"))
    answers = responses.filter((F.coalesce("skipped", F.lit(0)) == 0) & said.isin("a_much", "a_slight", "b_slight", "b_much") & (F.trim("pair_kind") == kind))
    answers = answers.select("response_id", "pair_id", left.cast("int").alias("won")).na.drop()
    once = answers.groupBy("response_id", "pair_id").agg(F.max("won").alias("won"))
    votes = once.groupBy("pair_id").agg(F.sum("won").alias("a"), F.sum(1 - F.col("won")).alias("b"))
    known = pairs.filter(F.trim("pair_kind") == kind).select("pair_id", bare_id("doc_a_id").alias("x"), bare_id("doc_b_id").alias("y")).na.drop()
    known = known.groupBy("pair_id").agg(F.min("x").alias("x"), F.min("y").alias("y")).filter("x <> y")
    both = votes.join(known, "pair_id")
    ahead = F.col("x") < F.col("y")
    edge = both.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("n"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("m"))
    return edge.groupBy("i", "j").agg(F.sum("n").alias("n_ij"), F.sum("m").alias("n_ji"))


def _tail(u: Column) -> Column:
    """erfc(x) exp(x^2) from u = 1 / (1 + x / 2), x >= 0."""
    series = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        series = series * u + c
    return u * F.exp(series)


def _ratio(t: Column, tail: Column, bell: Column) -> Column:
    """V(t) = pdf / cdf of the normal distribution, without overflow; ``tail`` for x = |t| / sqrt 2, ``bell`` = exp(-t^2 / 2)."""
    return 2 / (2 * 3.141592653589793) ** 0.5 * F.when(t < 0, 1 / tail).otherwise(bell / (2 - tail * bell))


def _state(e: DataFrame) -> DataFrame:
    """``item, p, h``: precision and precision times mean of each item."""
    i = F.struct(F.col("i").alias("item"), (F.col("n_ij") * F.col("ap") + F.col("n_ji") * F.col("cp")).alias("p"), (F.col("n_ij") * F.col("ah") + F.col("n_ji") * F.col("ch")).alias("h"))
    j = F.struct(F.col("j").alias("item"), (F.col("n_ij") * F.col("bp") + F.col("n_ji") * F.col("dp")).alias("p"), (F.col("n_ij") * F.col("bh") + F.col("n_ji") * F.col("dh")).alias("h"))
    summed = e.select(F.inline(F.array(i, j))).groupBy("item").agg(F.sum("p").alias("p"), F.sum("h").alias("h"))
    return summed.select("item", (F.col("p") + 1 / PRIOR_SD**2).alias("p"), "h")


def _update(joined: DataFrame) -> DataFrame:
    """New messages of both factors of each row (i beat j, j beat i), damped; ``joined`` has the items' states as x and y.

    In stages of named columns, so that no expression is written out twice in the plan.
    """
    keep = ["i", "j", "n_ij", "n_ji"]
    # precision and mean of each item without the one message that is replaced: of the winner (w) and the loser (l) of both factors
    ends = {"1w": ("x", "ap", "ah"), "1l": ("y", "bp", "bh"), "2w": ("y", "dp", "dh"), "2l": ("x", "cp", "ch")}
    cavity = joined.select(*keep, *_MESSAGES, *[(F.col(f"{s}.p") - F.col(p)).alias(f"k{e}") for e, (s, p, _) in ends.items()], *[(F.col(f"{s}.h") - F.col(h)).alias(f"e{e}") for e, (s, _, h) in ends.items()])
    means = cavity.withColumns({f"m{e}": F.col(f"e{e}") / F.col(f"k{e}") for e in ends} | {f"c{f}": 2 * NOISE_SD**2 + 1 / F.col(f"k{f}w") + 1 / F.col(f"k{f}l") for f in "12"})
    tests = means.withColumns({f"t{f}": (F.col(f"m{f}w") - F.col(f"m{f}l")) / F.sqrt(f"c{f}") for f in "12"})
    parts = tests.withColumns({f"u{f}": 1 / (1 + F.abs(f"t{f}") / 2**1.5) for f in "12"} | {f"b{f}": F.exp(-F.col(f"t{f}") * F.col(f"t{f}") / 2) for f in "12"})
    tails = parts.withColumns({f"s{f}": _tail(F.col(f"u{f}")) for f in "12"})
    ratio = tails.withColumns({f"v{f}": _ratio(F.col(f"t{f}"), F.col(f"s{f}"), F.col(f"b{f}")) for f in "12"})
    both = ratio.withColumns({f"w{f}": F.least(F.greatest(F.col(f"v{f}") * (F.col(f"v{f}") + F.col(f"t{f}")), F.lit(1e-9)), F.lit(1 - 1e-9)) for f in "12"})
    moved = lambda old, new, e: F.abs(new - old) / F.col(f"k{e}")
    new = both.withColumns({f"p{e}": F.col(f"k{e}") / (1 - F.col(f"w{e[0]}") / (F.col(f"k{e}") * F.col(f"c{e[0]}"))) for e in ends})
    out, far = [], []
    for e, (_, p, h) in ends.items():
        mean = F.col(f"m{e}") + (1 if e[1] == "w" else -1) * F.col(f"v{e[0]}") / (F.col(f"k{e}") * F.sqrt(f"c{e[0]}"))
        far.append(moved(F.col(h), F.col(f"p{e}") * mean - F.col(f"e{e}"), e))
        out += [(F.col(p) + DAMPING * (F.col(f"p{e}") - F.col(f"k{e}") - F.col(p))).alias(p), (F.col(h) + DAMPING * (F.col(f"p{e}") * mean - F.col(f"e{e}") - F.col(h))).alias(h)]
    return new.select(*keep, *out, F.greatest(*far).alias("moved"))


def skills(compared: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, mean, sd, lower_bound, wins, losses`` of every compared item, from rows ``i, j, n_ij, n_ji``.

    Items of parts of the graph that no comparison links are all measured against the same prior. An empty table gives an
    empty result.
    """
    key = lambda c: F.xxhash64(c)
    base = durable(compared.filter("n_ij + n_ji > 0").select("i", "j", F.col("n_ij").cast("double").alias("n_ij"), F.col("n_ji").cast("double").alias("n_ji")))
    names = base.select(F.inline(F.array(F.struct(F.col("i").alias("doc_id"), F.col("n_ij").alias("w"), F.col("n_ji").alias("l")), F.struct(F.col("j").alias("doc_id"), F.col("n_ji").alias("w"), F.col("n_ij").alias("l")))))
    names = names.groupBy("doc_id").agg(F.sum("w").cast("bigint").alias("wins"), F.sum("l").cast("bigint").alias("losses"))
    small = names.count() <= BROADCAST_ITEMS
    e = base.select(key("i").alias("i"), key("j").alias("j"), "n_ij", "n_ji", *[F.lit(0.0).alias(m) for m in _MESSAGES])
    steps = Steps(base.sparkSession)
    for _ in range(rounds):
        seen = Observation()
        state = _state(e)
        held = F.broadcast(state) if small else state
        joined = e.join(held.alias("x"), F.col("i") == F.col("x.item")).join(held.alias("y"), F.col("j") == F.col("y.item"))
        # the largest change comes with the write of the round, not by a job of its own
        e = steps.next(_update(joined).observe(seen, F.max("moved").alias("most")).drop("moved"))
        if (seen.get["most"] or 0.0) < TOLERANCE:
            break
    mean, sd = F.col("h") / F.col("p"), 1 / F.sqrt("p")
    out = names.join(_state(e).withColumnRenamed("item", "key"), key("doc_id") == F.col("key"))
    return out.select("doc_id", mean.alias("mean"), sd.alias("sd"), (mean - CAUTION * sd).alias("lower_bound"), "wins", "losses")


def ranking(compared: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """:func:`skills` with a 1-based ``position`` by the lower bound, ties by ``doc_id``."""
    return numbered(skills(compared, rounds), [F.desc(F.round("lower_bound", 9)), F.asc("doc_id")])
