"""Analytics of pairwise human preferences: un-blinding, agreement, dashboards, win counts, Bradley-Terry scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siktverk.functions.domains import SAMPLER, ordinal
from siktverk.functions.ids import bare_id
from siktverk.operators.ordering import quantiles
from siktverk.sources.durable import Steps

CHOICES = ("a_much", "a_slight", "b_slight", "b_much")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cleaned(responses: DataFrame) -> DataFrame:
    """One row a ``response_id``, names and choices in lower case without surrounding blanks, ``skipped`` as boolean."""
    text = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    once = responses.dropDuplicates(["response_id"])
    return once.withColumns({"rater_name": text("rater_name"), "readability_choice": text("readability_choice"), "substance_choice": text("substance_choice"), "skipped": F.coalesce(F.col("skipped") != 0, F.lit(False))})


def chosen(choice: Column | str, side: Column | str) -> Column:
    """The document (``a`` or ``b``) behind a choice made on sides; null without a choice."""
    c, s = _col(choice), _col(side)
    return F.when(c.isNotNull() & s.isNotNull(), F.when(c.startswith("a_") == (s == "a_left"), "a").otherwise("b"))


def agreement_class(pick: Column | str, a: Column | str, b: Column | str, domain: str) -> Column:
    """``missing`` without a pick, ``unknown`` without both labels, ``tie``, else ``agree`` or ``disagree`` with the label order."""
    p, x, y = _col(pick), ordinal(a, SAMPLER[domain], trim=True), ordinal(b, SAMPLER[domain], trim=True)
    return F.when(p.isNull(), "missing").when(x.isNull() | y.isNull(), "unknown").when(x == y, "tie").when((p == "a") == (x > y), "agree").otherwise("disagree")


def unique_pairs(pairs: DataFrame) -> DataFrame:
    """One row a ``pair_id`` with bare document ids."""
    keep = ["pair_kind", "is_duplicate", "doc_a_content_quality", "doc_b_content_quality", "doc_a_educational_value", "doc_b_educational_value", "calibration_correct_doc"]
    rows = pairs.select("pair_id", bare_id("doc_a_id").alias("doc_a_id"), bare_id("doc_b_id").alias("doc_b_id"), *keep)
    return rows.groupBy("pair_id").agg(*[F.min(c).alias(c) for c in rows.columns if c != "pair_id"])


def rated(responses: DataFrame, pairs: DataFrame) -> DataFrame:
    """Answered real pairs with picks, agreement classes and ``axes_diverged``."""
    known = unique_pairs(pairs).drop("pair_kind", "is_duplicate")
    r = cleaned(responses).filter((F.col("pair_kind") == "real") & ~F.col("skipped")).join(known, "pair_id")
    r = r.withColumns({"chosen_read_doc": chosen("readability_choice", "side_assignment"), "chosen_sub_doc": chosen("substance_choice", "side_assignment")})
    both = F.col("readability_choice").isNotNull() & F.col("substance_choice").isNotNull()
    return r.withColumns({
        "readability_agr": agreement_class("chosen_read_doc", "doc_a_content_quality", "doc_b_content_quality", "content_quality"),
        "substance_agr": agreement_class("chosen_sub_doc", "doc_a_educational_value", "doc_b_educational_value", "educational_value"),
        "axes_diverged": F.coalesce(both & (F.substring("readability_choice", 1, 1) != F.substring("substance_choice", 1, 1)), F.lit(False)),
        "both_answered": both,
    })


def agreement_rates(r: DataFrame, *by: str) -> DataFrame:
    """Per axis: counts of each class and rate = agree / (agree + disagree)."""
    rows = r.select(*by, F.inline(F.array(F.struct(F.lit("readability").alias("axis"), F.col("readability_agr").alias("agr")), F.struct(F.lit("substance").alias("axis"), F.col("substance_agr").alias("agr")))))
    kinds = ("agree", "disagree", "tie", "unknown", "missing")
    out = rows.groupBy(*by, "axis").agg(*[F.count_if(F.col("agr") == k).alias(k) for k in kinds])
    return out.withColumn("rate", F.try_divide(F.col("agree"), F.col("agree") + F.col("disagree")))


def separability(r: DataFrame, *by: str) -> DataFrame:
    """``answered, diverged, rate`` over answers on both axes."""
    out = r.groupBy(*by).agg(F.count_if("both_answered").alias("answered"), F.count_if("axes_diverged").alias("diverged"))
    return out.withColumn("rate", F.try_divide(F.col("diverged"), F.col("answered")))


def inter_rater(responses: DataFrame) -> DataFrame:
    """Per axis: rater pairs of a repeated real pair, how many pick the same document, and how many give the same choice.

    From counts of each (pair, answer): n (n - 1) / 2 pairs of equal answers, so that a pair with many raters is not joined
    with itself. A rater's several answers to a pair count as one, the largest.
    """
    r = cleaned(responses).filter((F.col("pair_kind") == "real") & (F.col("is_duplicate") == 1) & ~F.col("skipped"))
    long = r.select("pair_id", "rater_name", "side_assignment", F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"{a}_choice").alias("choice")) for a in ("readability", "substance")])))
    long = long.filter("choice is not null").withColumn("doc", chosen("choice", "side_assignment")).withColumn("exact", F.concat("doc", F.regexp_extract("choice", "_(.*)$", 1)))
    one = long.groupBy("axis", "pair_id", "rater_name").agg(F.max(F.struct("doc", "exact")).alias("v")).select("axis", "pair_id", "v.doc", "v.exact")
    half = lambda c: c * (c - 1) / 2
    cells = one.groupBy("axis", "pair_id", "doc", "exact").agg(F.count("*").alias("n"))
    docs = cells.groupBy("axis", "pair_id", "doc").agg(F.sum("n").alias("n"), F.sum(half(F.col("n"))).alias("e"))
    per = docs.groupBy("axis", "pair_id").agg(half(F.sum("n")).alias("p"), F.sum(half(F.col("n"))).alias("b"), F.sum("e").alias("e"))
    out = per.groupBy("axis").agg(F.sum("p").cast("bigint").alias("rater_pairs"), F.sum("b").cast("bigint").alias("same_document"), F.sum("e").cast("bigint").alias("same_choice"))
    return out.withColumns({"binary_rate": F.try_divide("same_document", "rater_pairs"), "exact_rate": F.try_divide("same_choice", "rater_pairs")})


def timing(responses: DataFrame) -> DataFrame:
    """Per rater: answers with a time, median, p90 (linear), least and largest ``time_ms`` of answers not skipped."""
    r = cleaned(responses).filter(~F.col("skipped") & F.col("time_ms").isNotNull() & F.col("rater_name").isNotNull()).select("rater_name", "time_ms")
    ends = r.groupBy("rater_name").agg(F.count("*").alias("n"), F.min("time_ms").alias("min_ms"), F.max("time_ms").alias("max_ms"))
    middle = quantiles(r, "rater_name", "time_ms", {"median_ms": 0.5, "p90_ms": 0.9})
    return ends.join(middle, "rater_name").select("rater_name", "n", "median_ms", "p90_ms", "min_ms", "max_ms")


def calibration(responses: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per rater and kind of calibration pair: right answers on its axis, answers, and their share."""
    known = unique_pairs(pairs).select("pair_id", "calibration_correct_doc").filter("calibration_correct_doc is not null")
    r = cleaned(responses).filter(F.col("pair_kind").isin("calibration_readability", "calibration_substance") & ~F.col("skipped"))
    choice = F.when(F.col("pair_kind") == "calibration_readability", F.col("readability_choice")).otherwise(F.col("substance_choice"))
    r = r.withColumn("pick", chosen(choice, "side_assignment")).filter("pick is not null").join(known, "pair_id")
    out = r.groupBy("rater_name", "pair_kind").agg(F.count_if(F.col("pick") == F.col("calibration_correct_doc")).alias("correct"), F.count("*").alias("total"))
    return out.withColumn("accuracy", F.col("correct") / F.col("total"))


def dashboard(responses: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per rater: totals by kind, mean time, accuracy on both kinds of calibration pairs (null without any), choice counts, divergence."""
    r = cleaned(responses)
    done = ~F.col("skipped")
    kind, again = F.col("pair_kind"), F.coalesce(F.col("is_duplicate") == 1, F.lit(False))
    both = done & F.col("readability_choice").isNotNull() & F.col("substance_choice").isNotNull()
    choices = [F.count_if(done & (F.col(f"{axis}_choice") == c)).alias(f"{axis}_{c}") for axis in ("readability", "substance") for c in CHOICES]
    board = r.groupBy("rater_name").agg(
        F.count("*").alias("total"), F.count_if("skipped").alias("skipped"), F.count_if(done & (kind == "real") & ~again).alias("real_count"), F.count_if(done & again).alias("repeat_count"),
        F.count_if(done & (kind == "calibration_readability")).alias("cal_read_count"), F.count_if(done & (kind == "calibration_substance")).alias("cal_sub_count"), F.avg(F.when(done, F.col("time_ms"))).alias("mean_time_ms"),
        *choices, F.count_if(both).alias("both_answered"), F.count_if(both & (F.substring("readability_choice", 1, 1) != F.substring("substance_choice", 1, 1))).alias("diverged"),
    )
    right = lambda k: F.max(F.when(F.col("pair_kind") == k, F.col("accuracy")))
    accuracy = calibration(responses, pairs).groupBy("rater_name").agg(right("calibration_readability").alias("cal_read_accuracy"), right("calibration_substance").alias("cal_sub_accuracy"))
    return board.join(accuracy, "rater_name", "left")


def display_sides(responses: DataFrame, pairs: DataFrame) -> DataFrame:
    """``response_id, pair_id, display_a_id, display_b_id``: which document of the pair stood on which side; null sides show b first."""
    known = unique_pairs(pairs).select("pair_id", "doc_a_id", "doc_b_id")
    left = F.col("side_assignment") == "a_left"
    shown = lambda x, y: F.when(left, F.col(f"doc_{x}_id")).otherwise(F.col(f"doc_{y}_id"))
    return cleaned(responses).select("response_id", "pair_id", "side_assignment").join(known, "pair_id").select("response_id", "pair_id", shown("a", "b").alias("display_a_id"), shown("b", "a").alias("display_b_id"))


def next_tasks(assignments: DataFrame, responses: DataFrame) -> DataFrame:
    """``rater_name, queue_position, pair_id``: the first pair of each rater's queue without a response; a skipped pair has one.

    Raters whose queue is done are left out. Names are taken in lower case without surrounding blanks.
    """
    name = F.lower(F.regexp_replace("rater_name", r"^\s+|\s+$", "")).alias("rater_name")
    queue = assignments.select(name, "pair_id", "queue_position").na.drop()
    done = responses.select(name, "pair_id").na.drop().distinct()
    left = queue.join(done, ["rater_name", "pair_id"], "left_anti")
    return left.groupBy("rater_name").agg(F.min("queue_position").alias("queue_position"), F.min_by("pair_id", F.struct("queue_position", "pair_id")).alias("pair_id"))


def outcomes(responses: DataFrame, pairs: DataFrame) -> DataFrame:
    """``winner, loser``: an outcome of each axis that a not skipped response to a known real pair answers; one answered axis counts alone."""
    known = unique_pairs(pairs).select("pair_id", "doc_a_id", "doc_b_id")
    r = cleaned(responses).filter(~F.col("skipped") & (F.col("pair_kind") == "real")).join(known, "pair_id")
    picks = r.select("doc_a_id", "doc_b_id", F.explode(F.array(chosen("readability_choice", "side_assignment"), chosen("substance_choice", "side_assignment"))).alias("pick"))
    a = F.col("pick") == "a"
    return picks.filter("pick is not null").select(F.when(a, F.col("doc_a_id")).otherwise(F.col("doc_b_id")).alias("winner"), F.when(a, F.col("doc_b_id")).otherwise(F.col("doc_a_id")).alias("loser"))


def edges(won: DataFrame) -> DataFrame:
    """``winner, loser, n``."""
    return won.groupBy("winner", "loser").agg(F.count("*").alias("n"))


def win_loss(won: DataFrame) -> DataFrame:
    """``doc_id, wins, losses, n_comparisons``."""
    rows = won.select(F.inline(F.array(F.struct(F.col("winner").alias("doc_id"), F.lit(1).alias("w"), F.lit(0).alias("l")), F.struct(F.col("loser").alias("doc_id"), F.lit(0).alias("w"), F.lit(1).alias("l")))))
    return rows.groupBy("doc_id").agg(F.sum("w").alias("wins"), F.sum("l").alias("losses"), F.count("*").alias("n_comparisons"))


def bradley_terry(won: DataFrame, iterations: int = 500, tolerance: float = 1e-9) -> DataFrame:
    """``doc_id, log_odds, score01, wins, losses, n_comparisons`` by minorization-maximization on aggregated edges.

    Every third update starts from a squared extrapolation of the two before (SQUAREM), which is dropped if it then moves
    more than three times as far as the first of them. Ends after ``iterations`` updates, or when one changes no log strength by ``tolerance``.

    Every document also has half a win and half a loss against a ghost of strength 1 before scaling, so that documents that
    never won or never lost stay finite. A few numbers an update reach the driver; log strengths have mean 0 in the end, ``score01`` is their min-max scale.
    """
    spark = won.sparkSession
    e = edges(won)
    both = e.select(F.least("winner", "loser").alias("i"), F.greatest("winner", "loser").alias("j"), "n").filter("i <> j").groupBy("i", "j").agg(F.sum("n").alias("n"))
    fixed = Steps(spark).next(both.select(F.inline(F.array(F.struct(F.col("i").alias("d"), F.col("j").alias("o"), "n"), F.struct(F.col("j").alias("d"), F.col("i").alias("o"), "n")))))
    table = win_loss(won)
    base = Steps(spark).next(table)
    steps = Steps(spark)
    s, g = steps.next(base.select("doc_id", (F.col("wins") + 0.5).alias("w"), F.lit(0.0).alias("x"))), 0.0

    def updated(s: DataFrame, g: float, at: str, to: str) -> tuple[DataFrame, float]:
        """Adds the update ``to`` of the log strengths ``at``; that of the ghost, whose log strength is ``g``."""
        one, other = s.select("doc_id", F.exp(at).alias("s")).alias("one"), s.select("doc_id", F.exp(at).alias("s")).alias("other")
        load = fixed.join(one, F.col("d") == F.col("one.doc_id")).join(other, F.col("o") == F.col("other.doc_id")).groupBy("d").agg(F.sum(F.col("n") / (F.col("one.s") + F.col("other.s"))).alias("load"))
        ghost = 1 / (F.exp(at) + math.exp(g))
        new = s.join(load, F.col("doc_id") == F.col("d"), "left").select(*s.columns, F.log(F.col("w") / (F.coalesce("load", F.lit(0.0)) + ghost)).alias(to), ghost.alias(f"ghost_{to}"))
        new = steps.next(new)
        total = new.agg(F.sum(f"ghost_{to}").alias("g"), F.count("*").alias("n")).first()
        return new.drop(f"ghost_{to}"), math.log(0.5 * total["n"] / total["g"]) if total["n"] else g

    done = 0
    while done < iterations:
        s, ga = updated(s, g, "x", "a")
        s, gb = updated(s, ga, "a", "b")
        done += 2
        r, v = F.col("a") - F.col("x"), F.col("b") - 2 * F.col("a") + F.col("x")
        got = s.agg(F.sum(r * r).alias("r"), F.sum(v * v).alias("v"), F.max(F.abs(r)).alias("far"), F.max(F.abs(F.col("b") - F.col("a"))).alias("near")).first()
        if got["far"] is None or got["near"] < tolerance or done >= iterations:
            s = s.select("doc_id", "w", F.col("b").alias("x"))
            break
        rg, vg = ga - g, gb - 2 * ga + g
        step = max(1.0, math.sqrt((got["r"] + rg * rg) / max(got["v"] + vg * vg, 1e-300)))
        gy = g + 2 * step * rg + step * step * vg
        s, gz = updated(s.select("doc_id", "w", "b", (F.col("x") + 2 * step * r + step * step * v).alias("y")), gy, "y", "z")
        done += 1
        moved = s.agg(F.max(F.abs(F.col("z") - F.col("y"))).alias("m")).first()["m"]
        keep = moved is not None and moved <= 3 * got["far"]
        s, g = s.select("doc_id", "w", F.col("z" if keep else "b").alias("x")), gz if keep else gb
        if keep and moved < tolerance:
            break
    logs = s.select("doc_id", "x")
    r = logs.agg(F.avg("x").alias("m"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    out = logs.crossJoin(F.broadcast(r)).join(base, "doc_id")  # r is one row
    return out.select("doc_id", F.round(F.col("x") - F.col("m"), 4).alias("log_odds"), F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")).alias("score01"), "wins", "losses", "n_comparisons")

