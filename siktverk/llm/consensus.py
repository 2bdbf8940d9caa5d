"""Consensus from several annotators' labels (problem 7).

Method: expectation-maximisation over item labels and annotators' confusion matrices, with smoothing; chance-corrected
agreement is reported apart from it. The labels are which document of a pair is the better one, undone of the sides.

Answers are kept once a (pair, rater), hashed and partitioned by pair; a round moves one number an answer to its pair and
a few sums to each rater, with map-side combine. A pair or a rater that holds a third of all answers is pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siktverk.sources.durable import Steps, durable

#: Pseudo-counts added to every cell of a confusion matrix (more on the diagonal, which names the labels), and rounds.
SMOOTHING, DIAGONAL, ROUNDS = 1.0, 1.5, 8
#: Raters up to which their matrices (24 bytes each) are broadcast to the answers; beyond, both are shuffled.
BROADCAST_RATERS = 500_000
#: Informedness (sensitivity + specificity - 1) under which a rater's answers tell nothing or the contrary, and answers needed to say
#: so. It is 0 for guesses and about two thirds for careful raters; over 25 answers it is estimated to about 0.2, so the middle parts them.
LEAST_INFORMED, LEAST_ANSWERS = 1 / 3, 25


def answers(responses: DataFrame, choice: str = "readability_choice") -> DataFrame:
    """``pair_id, rater_name, a, b, first``: answers of a rater to a pair for either document, and how many were first showings.

    Given, not skipped answers count once a ``response_id``. Rater names and choices are taken in lower case without
    surrounding blanks; rows that lack a needed value are left out.
    """
    said = F.lower(F.trim(F.col(choice)))
    side = F.trim("side_assignment")
    a = F.when(side == "a_left", said.startswith("a_")).when(side == "a_right", said.startswith("b_")).cast("int")
    rater = F.lower(F.regexp_replace("rater_name", r"^\s+|\s+$", ""))
    kept = responses.filter((F.coalesce("skipped", F.lit(0)) == 0) & said.isin("a_much", "a_slight", "b_slight", "b_much"))
    first = (F.coalesce("is_duplicate", F.lit(0)) == 0).cast("int")
    rows = kept.select("pair_id", rater.alias("rater_name"), "response_id", (a * 2 + first).alias("code")).na.drop()
    parts = int(responses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = rows.repartition(parts, "pair_id", "rater_name").groupBy("pair_id", "rater_name", "response_id").agg(F.max("code").alias("code"))
    chose = F.col("code") >= 2
    return once.groupBy("pair_id", "rater_name").agg(F.count_if(chose).alias("a"), F.count_if(~chose).alias("b"), F.sum(F.col("code") % 2).alias("first"))


class Model:
    """Posteriors of pairs and matrices of raters after expectation-maximisation."""

    def __init__(self, given: DataFrame, rounds: int = ROUNDS) -> None:
        spark = given.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        keyed = given.withColumns({"p": F.xxhash64("pair_id"), "r": F.xxhash64("rater_name")})
        self.given = durable(keyed.repartition(parts, "p"))  # written with its partitioning, so that rounds don't move it
        slim = self.given.select("p", "r", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
        share = slim.groupBy("p").agg((F.sum("a") / F.sum(F.col("a") + F.col("b"))).alias("q"))
        steps = Steps(spark)
        self.raters = steps.next(self._matrices(slim, share))
        small = self.raters.count() <= BROADCAST_RATERS
        for _ in range(rounds - 1):
            self.raters = steps.next(self._matrices(slim, self._posteriors(slim, small)))
        self.pairs = self._posteriors(slim, small)

    def _posteriors(self, slim: DataFrame, small: bool) -> DataFrame:
        """``p, q``: probability that the first document of a pair is the better one."""
        sens, spec = F.col("sens"), F.col("spec")
        weights = self.raters.select("r", F.log(sens / (1 - spec)).alias("wa"), F.log((1 - sens) / spec).alias("wb"))
        joined = slim.join(F.broadcast(weights) if small else weights, "r")
        odds = joined.groupBy("p").agg(F.sum(F.col("a") * F.col("wa") + F.col("b") * F.col("wb")).alias("odds"))
        return odds.select("p", (1 / (1 + F.exp(-F.greatest(F.least("odds", F.lit(40.0)), F.lit(-40.0))))).alias("q"))

    @staticmethod
    def _matrices(slim: DataFrame, posteriors: DataFrame) -> DataFrame:
        """``r, sens, spec``: how often a rater says a where it is a, and b where it is b."""
        q, a, b = F.col("q"), F.col("a"), F.col("b")
        sums = slim.join(posteriors, "p").groupBy("r").agg(F.sum(q * a).alias("aa"), F.sum(q * b).alias("ab"), F.sum((1 - q) * b).alias("bb"), F.sum((1 - q) * a).alias("ba"))
        rate = lambda x, y: (F.col(x) + DIAGONAL * SMOOTHING) / (F.col(x) + F.col(y) + (1 + DIAGONAL) * SMOOTHING)
        return sums.select("r", rate("aa", "ab").alias("sens"), rate("bb", "ba").alias("spec"))

    def consensus(self) -> DataFrame:
        """``pair_id, label, probability, answers, agreement``: the better document, its probability, and the share of answers that say so."""
        counts = self.given.groupBy("p", "pair_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        q, n = F.col("q"), F.col("a") + F.col("b")
        out = counts.join(self.pairs, "p")
        return out.select("pair_id", F.when(q >= 0.5, "a").otherwise("b").alias("label"), F.greatest(q, 1 - q).alias("probability"), n.alias("answers"), (F.when(q >= 0.5, F.col("a")).otherwise(F.col("b")) / n).alias("agreement"))

    def reliability(self) -> DataFrame:
        """``rater_name, answers, first_showings, sensitivity, specificity, informedness``."""
        counts = self.given.groupBy("r", "rater_name").agg(F.sum(F.col("a") + F.col("b")).alias("answers"), F.sum("first").alias("first_showings"))
        out = counts.join(self.raters, "r")
        return out.select("rater_name", "answers", "first_showings", F.col("sens").alias("sensitivity"), F.col("spec").alias("specificity"), (F.col("sens") + F.col("spec") - 1).alias("informedness"))


def agreement(given: DataFrame) -> DataFrame:
    """One row ``pairs, answers, observed, expected, alpha``: agreement of two random answers to a pair, by chance, and Krippendorff's alpha.

    Over pairs with at least two answers; null where there are none, alpha also where chance agreement is complete.
    """
    per = given.groupBy("pair_id").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b")).filter("a + b >= 2")
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    s = per.agg(F.count("*").alias("pairs"), F.coalesce(F.sum(a + b), F.lit(0.0)).alias("n"), F.sum((a * (a - 1) + b * (b - 1)) / (a + b - 1)).alias("o"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    s = s.select("pairs", n.cast("bigint").alias("answers"), F.try_divide("o", "n").alias("observed"), F.try_divide(a * (a - 1) + b * (b - 1), n * (n - 1)).alias("expected"))
    return s.withColumn("alpha", F.try_divide(F.col("observed") - F.col("expected"), 1 - F.col("expected")))


def unreliable(model: Model) -> DataFrame:
    """``rater_name`` of raters whose answers tell nothing or the contrary, over at least 25 first showings."""
    return model.reliability().filter((F.col("informedness") < LEAST_INFORMED) & (F.col("first_showings") >= LEAST_ANSWERS)).select("rater_name")
