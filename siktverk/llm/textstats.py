"""Per-document text statistics, and which documents are not prose (problem 4).

Method: one pass computes the statistics; mergeable quantile sketches (KLL) of each statistic are built per language over the
distinct texts, so that copies don't move the quartiles; each value becomes a robust z-score against its language, and
documents in the tails are flagged.

Languages and their common words come from the corpus, not from lists: of the texts that no language found so far covers, the most
frequent word makes a group, and the words that a good share of the group's texts have and that are written small and lead on to another word are
its common words (articles, prepositions and the like hardly ever end a phrase, as nouns do, and are no names). A group is a language if there are
enough such words, if they make up as much of its texts as common words do, and clearly more than those of the languages found before,
and if most of its texts have the form of prose; lists and tables have none. Counts are sums over distinct texts of words of bounded number. Texts of no language are prose only by their form.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siktverk.functions.ids import bare_id
from siktverk.sources.durable import Steps
from siktverk.sources.tables import spread

_WORD, _DIGIT = re.compile(r"[^\W\d_]+"), re.compile(r"\d")
#: A word, and the blank after it if it leads on to another word or a number.
_LEADING = re.compile(r"([^\W\d_]+)(?:( )(?=[^\W_]))?")
_ENDS = re.compile("[.!?…][\"'”’»)\\]]*$")
_SENTENCE = re.compile("[.!?…][\"'”’»)\\]]*(?=\\s|$)")

STATISTICS = ("word_count", "mean_word_length", "symbol_ratio", "digit_ratio", "line_end_ratio", "common_word_ratio", "words_per_line")
#: Words that languages are told by: the most frequent ones over distinct texts, in LEAST_TEXTS of them at least.
FREQUENT, LEAST_TEXTS = 5000, 4
#: Groups that are looked at in one pass, and groups refused in a row that end the search.
GROUPS, REFUSED = 12, 24
#: A common word of a language is in so large a share of its texts, is written small so often, and then leads on so often; a language has so many of them at least
#: and at most, the most frequent ones. They make up so much of its texts, and so much of what they do in the other languages, and
#: so large a share of the texts has the form of prose.
IN_TEXTS, SMALL, LEADS, LEAST_WORDS, MOST_WORDS, LEAST_COVER, LIKE_OTHERS, SHAPED = 0.25, 0.3, 0.88, 8, 32, 0.15, 0.7, 0.5
#: The common words of a further language make up so many times as much of its texts as those of the languages found before.
GAIN = 1.5
#: A text belongs to the language whose common words are nearest to what they usually make up, if they are this much of it. Texts
#: that have less than the second share of it are looked through for more languages, as near relatives share many words.
COVERED, SURE = 0.62, 0.75
#: What damaged prose and prose of a near relative have of it at least.
NEAR = 0.35
#: Robust z-scores of the common-word ratio that make a document no prose: alone, with another tail, with a tail of digits or symbols.
ALONE, WITH_TAIL, WITH_MARKS = -5.0, -3.0, -2.0
#: A robust z-score beyond this is a tail.
TAIL = 3.5
#: A text of no language is prose if few of its words are frequent ones of known languages, and if it has sentences of so many words,
#: lines of so many, words of so many letters, and few digits and symbols.
FAMILIAR, SENTENCE_WORDS, LINE_WORDS, LETTERS, MARKS = 0.3, (4, 60), 5, 2.5, 0.2
CACHED_WORDS = 200_000


def word_hash(word: str) -> int:
    return xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"))


@dataclass
class Languages:
    """Hashes of the frequent words in order, which of them texts of known languages have for the most part, the common ones of each language, and the share that these usually make up."""

    words: np.ndarray
    familiar: np.ndarray
    common: list[np.ndarray] = field(default_factory=list)
    usual: list[float] = field(default_factory=list)
    #: Places of words that were looked up; memory only.
    known: dict[str, int] = field(default_factory=dict, repr=False)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Places among the frequent words, -1 for others."""
        at = np.searchsorted(self.words, hashes)
        return np.where((at < len(self.words)) & (self.words[np.minimum(at, len(self.words) - 1)] == hashes), at, -1) if len(self.words) else np.full(len(hashes), -1)

    def familiarity(self, places: np.ndarray, counts: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each text the share of familiar words."""
        use = (places >= 0) & (self.familiar[np.maximum(places, 0)] if len(self.words) else False)
        return np.bincount(owner[use], counts[use], len(sizes)) / np.maximum(sizes, 1)

    def assign(self, places: np.ndarray, counts: np.ndarray, owner: np.ndarray, sizes: np.ndarray, least: float = COVERED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: its language (-1 for none), the share of common words (of its language, or else of the nearest), and that share by the usual one."""
        n = len(sizes)
        held = places >= 0
        share = np.zeros((max(1, len(self.common)), n))
        for k, common in enumerate(self.common):
            use = held & common[np.maximum(places, 0)]
            share[k] = np.bincount(owner[use], counts[use], n) / np.maximum(sizes, 1)
        fit = share / np.array(self.usual or [1.0])[:, None]
        best = fit.argmax(axis=0)
        rows = np.arange(n)
        return np.where(bool(self.common) & (fit[best, rows] >= least), best, -1), share[best, rows], fit[best, rows]

    def of(self, texts: list[str]) -> list[tuple[str | None, bool]]:
        """Language of each text (null for none) and whether it is prose, for texts in memory.

        Damaged prose has fewer common words than other prose: with NEAR of what is usual, its form decides.
        """
        words, counts, owner, sizes = [], [], [], []
        for k, text in enumerate(texts):
            found = Counter(_WORD.findall(text.lower()))
            words += found
            counts += found.values()
            owner += [k] * len(found)
            sizes.append(found.total())
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        self.known.update(zip(new, self.places(np.array([word_hash(w) for w in new], dtype=np.int64)).tolist()))
        places = np.array([self.known[w] for w in words], dtype=np.int64)
        at, size = np.array(owner, dtype=np.int64), np.array(sizes, dtype=np.int64)
        n = np.array(counts, dtype=np.int64)
        language, _, fit = self.assign(places, n, at, size, NEAR)
        familiar = self.familiarity(places, n, at, size)
        # as in :func:`quality`, but for the z-scores
        return [(name(k), k >= 0 and near >= COVERED or (k >= 0 or f < FAMILIAR) and shaped(t, measure(t))) for k, near, f, t in zip(language, fit, familiar, texts)]


def name(k: int) -> str | None:
    return f"l{k + 1}" if k >= 0 else None


def shaped(text: str, m: tuple[int, int, float, float, float, float, float]) -> bool:
    """Whether a text with the statistics ``m`` has the form of prose: sentences, long lines, words of several letters, few digits and symbols."""
    sentences = len(_SENTENCE.findall(text))
    return bool(sentences) and SENTENCE_WORDS[0] <= m[1] / sentences <= SENTENCE_WORDS[1] and m[6] >= LINE_WORDS and m[2] >= LETTERS and m[3] + m[4] <= MARKS


def measure(text: str, words: int | None = None, letters: int = 0) -> tuple[int, int, float, float, float, float, float]:
    """``char_count, word_count, mean_word_length, symbol_ratio, digit_ratio, line_end_ratio, words_per_line`` of one text, whose words and letters may be counted already."""
    if words is None:
        found = _WORD.findall(text)
        words, letters = len(found), sum(map(len, found))
    lines = [s for line in text.split("\n") if (s := line.strip())]
    solid = sum(map(len, text.split())) or 1
    digits = len(_DIGIT.findall(text))
    ended = sum(1 for line in lines if _ENDS.search(line)) / max(1, len(lines))
    return len(text), words, letters / max(1, words), (solid - letters - digits) / solid, digits / solid, ended, words / max(1, len(lines))


_BASE = ("char_count bigint", "word_count bigint", "mean_word_length double", "symbol_ratio double", "digit_ratio double", "line_end_ratio double", "words_per_line double")


def measured(df: DataFrame, id_column: str = "id", text_column: str = "text") -> DataFrame:
    """``id`` (bare), the statistics that need no language, ``shaped``, ``text_id`` (a 128-bit hash), and for the distinct words their hashes ``w``, counts ``c``, how often they are written small, ``s``, and how often they lead on then, ``b``."""
    schema = "id string, " + ", ".join(_BASE) + ", shaped boolean, text_id binary, w array<bigint>, c array<int>, s array<int>, b array<int>"
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            rows: list[tuple] = []
            hashes: list[int] = []
            counts: list[int] = []
            small: list[int] = []
            leads: list[int] = []
            ends = [0]
            for x in batch.column(1):
                text = x.as_py()
                if text is None:
                    rows.append((None,) * 9)
                else:
                    all_: dict[str, int] = {}
                    low: dict[str, int] = {}
                    on: dict[str, int] = {}
                    letters = 0
                    for (w, blank), n in Counter(_LEADING.findall(text)).items():
                        letters += len(w) * n
                        lower = w.lower()
                        all_[lower] = all_.get(lower, 0) + n
                        if w[0].islower():
                            low[lower] = low.get(lower, 0) + n
                            if blank:
                                on[lower] = on.get(lower, 0) + n
                    m = measure(text, sum(all_.values()), letters)
                    rows.append((*m, shaped(text, m), xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))))
                    for w, n in all_.items():
                        h = known.get(w)
                        if h is None:
                            if len(known) > CACHED_WORDS:
                                known.clear()
                            h = known[w] = word_hash(w)
                        hashes.append(h)
                        counts.append(n)
                    small += [low.get(w, 0) for w in all_]
                    leads += [on.get(w, 0) for w in all_]
                ends.append(len(hashes))
            columns = list(zip(*rows)) if rows else [[]] * 9
            kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 5, pa.bool_(), pa.binary()]
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, t)) for v, t in ((hashes, pa.int64()), (counts, pa.int32()), (small, pa.int32()), (leads, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)], *lists], names=names)

    return spread(df.select(bare_id(id_column).alias("id"), F.col(text_column).cast("string"))).mapInArrow(run, schema)


def languages(rows: DataFrame) -> Languages:
    """Languages of the distinct texts of ``text_id, word_count, shaped, w, c, s, b``.

    The driver holds FREQUENT words, and for each of GROUPS groups a number for each of these.
    """
    spark = rows.sparkSession
    once = rows.filter("text_id is not null and word_count > 0").select("text_id", "word_count", "shaped", "w", "c", "s", "b").dropDuplicates(["text_id"])
    steps = Steps(spark)
    texts = steps.next(once.drop("text_id"))
    top = texts.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_TEXTS).orderBy(F.desc("n"), "w").limit(FREQUENT).toArrow()
    order = np.argsort(top["w"].to_numpy())
    frequency = everywhere = top["n"].to_numpy()[order].astype(np.int64)
    out = Languages(top["w"].to_numpy()[order].astype(np.int64), np.ones(len(order), dtype=bool))
    tried: set[int] = set()
    refused = 0
    while refused < REFUSED:
        seeds = [int(k) for k in np.argsort(-frequency, kind="stable") if int(k) not in tried and frequency[k] >= LEAST_TEXTS][:GROUPS]
        if not seeds:
            break
        held = spark.sparkContext.broadcast((out, seeds))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, groups = held.value
            v = len(known.words)
            in_texts, in_words, low, leads = (np.zeros((len(groups) + 1, v + 2), dtype=np.int64) for _ in range(4))
            for batch in batches:
                size, lists = batch.column(0).to_numpy(), batch.column(1)
                owner = np.repeat(np.arange(len(size)), np.diff(lists.offsets.to_numpy()))
                places = known.places(lists.flatten().to_numpy())
                counts, small, on = (batch.column(k).flatten().to_numpy() for k in (2, 3, 4))
                shaped_ = np.array(batch.column(5))
                language, share, _ = known.assign(places, counts, owner, size, SURE)
                left = language < 0
                for g, seed in enumerate([*groups, -1]):  # the last row is all that is left in the form of prose
                    inside = left & shaped_ if seed < 0 else left.copy()
                    if seed >= 0:
                        has = np.zeros(len(size), dtype=bool)
                        has[owner[places == seed]] = True
                        inside &= has
                    use = inside[owner] & (places >= 0)
                    in_texts[g, :v] += np.bincount(places[use], minlength=v)
                    in_words[g, :v] += np.bincount(places[use], counts[use], v).astype(np.int64)
                    low[g, :v] += np.bincount(places[use], small[use], v).astype(np.int64)
                    leads[g, :v] += np.bincount(places[use], on[use], v).astype(np.int64)
                    in_texts[g, v] += int(inside.sum())
                    in_words[g, v] += int(size[inside].sum())
                    leads[g, v] += int((inside & shaped_).sum())
                    in_texts[g, v + 1] += int(inside.sum())
                    in_words[g, v + 1] += int(np.rint((size * share)[inside].sum()))
            g, w = np.nonzero(in_texts)
            yield pa.RecordBatch.from_pydict({"g": pa.array(g, pa.int32()), "w": pa.array(w, pa.int32()), "t": pa.array(in_texts[g, w], pa.int64()), "n": pa.array(in_words[g, w], pa.int64()), "s": pa.array(low[g, w], pa.int64()), "b": pa.array(leads[g, w], pa.int64())})

        got = texts.select("word_count", "w", "c", "s", "b", "shaped").mapInArrow(run, "g int, w int, t bigint, n bigint, s bigint, b bigint").groupBy("g", "w").agg(*[F.sum(x).alias(x) for x in "tnsb"]).toArrow()
        v = len(out.words)
        t, n, low, b = (np.zeros((len(seeds) + 1, v + 2), dtype=np.int64) for _ in range(4))
        at = got["g"].to_numpy(), got["w"].to_numpy()
        t[at], n[at], low[at], b[at] = (got[x].to_numpy() for x in "tnsb")
        frequency = t[-1, :v]
        out.familiar = 2 * frequency <= everywhere
        found = False
        for g in sorted(range(len(seeds)), key=lambda g: (-t[g, v], seeds[g])):
            seed = seeds[g]
            tried.add(seed)
            if t[g, v] >= LEAST_TEXTS:
                fit = np.flatnonzero((t[g, :v] >= IN_TEXTS * t[g, v]) & (low[g, :v] >= SMALL * n[g, :v]) & (b[g, :v] >= LEADS * low[g, :v]))
                common = np.zeros(v, dtype=bool)
                common[fit[np.argsort(-t[g, fit], kind="stable")][:MOST_WORDS]] = True
                cover = n[g, :v][common].sum() / max(1, n[g, v])
                least = max(LEAST_COVER, LIKE_OTHERS * float(np.median(out.usual))) if out.usual else LEAST_COVER
                gain = cover * n[g, v] / max(1, n[g, v + 1])
                if common.sum() >= LEAST_WORDS and cover >= least and gain >= GAIN and b[g, v] >= SHAPED * t[g, v]:
                    out.common.append(common)
                    out.usual.append(float(cover))
                    found = True
                    break
            refused += 1
        if found:
            refused = 0
            tried.update(np.flatnonzero(out.common[-1]).tolist())
    steps.drop()
    return out


def statistics(df: DataFrame, id_column: str = "id", text_column: str = "text") -> DataFrame:
    """``id`` (bare), ``language``, ``char_count``, the statistics, ``familiar``, ``likeness``, ``shaped`` and ``text_id`` (a 128-bit hash), one row a row of ``df``.

    ``char_count`` counts the characters of the text itself; ``language`` is null where there is none, ``common_word_ratio`` is the
    share of the common words of the language, or of the nearest one, ``likeness`` that by the usual one, and ``familiar`` the share of
    frequent words of known languages. A null
    text has null statistics; an empty or blank one has zeros; null ids stay. Other columns are ignored.
    """
    spark = df.sparkSession
    rows = Steps(spark).next(measured(df, id_column, text_column))
    held = spark.sparkContext.broadcast(languages(rows))
    schema = "id string, " + ", ".join(_BASE) + ", shaped boolean, text_id binary, language string, common_word_ratio double, familiar double, likeness double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            size = np.nan_to_num(batch.column(2).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            lists = batch.column(10)
            owner = np.repeat(np.arange(len(size)), np.diff(lists.offsets.to_numpy()))
            places, counts = known.places(lists.flatten().to_numpy()), batch.column(11).flatten().to_numpy()
            language, share, fit = known.assign(places, counts, owner, size)
            familiar = known.familiarity(places, counts, owner, size)
            gone = ~np.array(batch.column(1).is_valid())
            new = [pa.array([name(k) for k in language], pa.string(), mask=gone), pa.array(share, pa.float64(), mask=gone), pa.array(familiar, pa.float64(), mask=gone), pa.array(fit, pa.float64(), mask=gone)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:10], *new], names=[f.split(" ")[0] for f in schema.split(", ")])

    columns = ["id", *[c.split(" ")[0] for c in _BASE], "shaped", "text_id", "w", "c"]
    return rows.select(*columns).mapInArrow(run, schema)


def sketches(stats: DataFrame) -> DataFrame:
    """``language, n`` and a KLL sketch of each statistic, over the distinct texts of a language; the row ``*`` is the merge of all languages."""
    once = stats.filter("language is not null").select("text_id", "language", *STATISTICS).dropDuplicates(["text_id"])
    one = once.groupBy("language").agg(F.count("*").alias("n"), *[F.expr(f"kll_sketch_agg_double(cast({k} as double))").alias(k) for k in STATISTICS])
    whole = one.agg(F.sum("n").alias("n"), *[F.expr(f"kll_merge_agg_double({k})").alias(k) for k in STATISTICS])
    return one.unionByName(whole.select(F.lit("*").alias("language"), "n", *STATISTICS))


def quality(stats: DataFrame) -> DataFrame:
    """``stats`` without ``text_id``, with a robust z-score ``<statistic>_z`` each, and ``prose``: false for lists, tables and junk, null without text.

    Scores are (value - median) / (interquartile range / 1.349) of the document's language, of all languages where it has none; the
    common-word ratio of a short text varies more, which its score allows for. The sketches' quartiles (a row a language) are collected.
    """
    quartile = lambda k, q: F.expr(f"kll_sketch_get_quantile_double({k}, {q})")
    read = sketches(stats).filter("n > 0").select("language", "n", *[quartile(k, q).alias(f"{k}_{i}") for k in STATISTICS for i, q in enumerate((0.25, 0.5, 0.75))])
    rows = {r["language"]: r for r in read.collect()}
    columns: dict[str, Column] = {}
    if "*" not in rows:
        columns = {f"{k}_z": F.lit(None).cast("double") for k in STATISTICS}
    else:
        for k in STATISTICS:

            def score(r: object, k: str = k) -> Column:
                lo, mid, hi = (float(r[f"{k}_{i}"]) for i in range(3))
                spread = max((hi - lo) / 1.349, 1e-3 * max(1.0, abs(mid)))
                if k != "common_word_ratio":
                    return (F.col(k) - mid) / spread
                return (F.col(k) - mid) / F.sqrt(spread**2 + mid * (1 - mid) / F.greatest("word_count", F.lit(1)))

            z = score(rows["*"])
            for language in rows:
                if language != "*":
                    z = F.when(F.col("language") == language, score(rows[language])).otherwise(z)
            columns[f"{k}_z"] = z
    out = stats.drop("text_id").withColumns(columns)
    z = {k: F.col(f"{k}_z") for k in STATISTICS}
    marks = F.coalesce((z["symbol_ratio"] > TAIL) | (z["digit_ratio"] > TAIL), F.lit(False))
    another = marks | (F.abs(z["mean_word_length"]) > TAIL) | (F.col("line_end_ratio") == 0)
    common = z["common_word_ratio"]
    junk = F.coalesce((common < ALONE) | (common < WITH_TAIL) & another | (common < WITH_MARKS) & marks, F.lit(False))
    foreign = ((F.col("familiar") < FAMILIAR) | (F.col("likeness") >= NEAR)) & F.col("shaped")
    prose = F.when(F.col("language").isNotNull(), ~junk).otherwise(foreign)
    return out.withColumn("prose", F.when(F.col("word_count") + F.col("char_count") > 0, prose)).drop("shaped")


def not_prose(df: DataFrame) -> DataFrame:
    """``id`` of documents (bare form) whose text is mostly a list, a table or junk; blank and missing texts are none."""
    texts = df.filter(F.length(F.regexp_replace("text", r"\s+", "")) > 0)
    return quality(statistics(texts)).filter(~F.col("prose") & F.col("id").isNotNull()).select("id").distinct()
