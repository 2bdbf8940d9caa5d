"""One consistent form for texts that look the same (problem 10).

Method: compatibility normalization of forms that keep their look, deletion of ignorable characters, then, for each word,
a lattice with one column per letter holding all its look-alikes. A Viterbi search picks the path with the best
script-consistent character bigram score. The lattice of a word and that of its look-alike are the same, so both end in
the same form whatever the scores are; the scores decide that the form is the one readers expect.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siktverk.sources.durable import Steps
from siktverk.sources.tables import spread

# Letters of three scripts that share a glyph, one class a word; Latin first, then Cyrillic and Greek.
CLASSES = "AАΑ BВΒ CСϹ EЕΕ HНΗ IІΙ JЈ KКΚ MМΜ NΝ OОΟ PРΡ QԚ SЅ TТΤ WԜ XХΧ YҮΥ ZΖ aа cсϲ dԁ eе hһ iі jј lӏ oоο pр qԛ sѕ vѵν wԝ xх yу".split()
GROUP = {c: g for g in CLASSES for c in g}
REPRESENTATIVE = str.maketrans({c: g[0] for g in CLASSES for c in g})

#: Decompositions that keep the look of a character, so that NFKC may be applied to it.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<compat>")
#: Bigrams never seen count as this much of one; a change of script inside a word costs as much as this many such bigrams.
FLOOR, SWITCH = 0.5, 3.0
CACHED_WORDS = 200_000


@lru_cache(maxsize=None)
def script(c: str) -> str:
    """L, C or G for Latin, Cyrillic and Greek letters, else an empty string."""
    name = unicodedata.name(c, "")
    return {"LATIN": "L", "CYRILLIC": "C", "GREEK": "G"}.get(name.partition(" ")[0], "") if name else ""


class _Simple(dict):
    """Translation of single characters, filled as they turn up."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        kind = unicodedata.category(c)
        if c == "\n":
            out: str | None = c
        elif c in "\r\v\f\x85  ":
            out = "\n"
        elif c == "\t" or kind == "Zs":
            out = " "
        elif kind in ("Cf", "Cc") or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or c in "͏ᅟᅠㅤﾠ឴឵":
            out = None
        elif (d := unicodedata.decomposition(c)).startswith("<"):
            out = unicodedata.normalize("NFKC", c) if d.startswith(SAME_LOOK) else c
        else:
            out = c
        self[code] = out
        return out


_SIMPLE = _Simple()
#: A joiner or a variation selector is part of the look after a symbol or in a script that shapes with joiners.
_SHAPED = re.compile("(?<=[©®‼-㋿\U0001f000-\U0001faff؀-ࣿऀ-෿‍️])[‌‍︎️]")
_KEEP = {"‌": "", "‍": "", "︎": "", "️": ""}
_BACK = str.maketrans({v: k for k, v in _KEEP.items()})
_PLAIN = re.compile("[\n\x20-\x7e¡-¬®-´¶-öø-ʯ–-‟‰-⁄€]*")
_WORD = re.compile("[^\\W\\d_](?:[^\\W\\d_]|[̀-ͯ])*")
_LATIN_OPEN = "".join(sorted(g[0] for g in CLASSES if script(g[0]) == "L"))
#: Words of a plain text that could be read in another script throughout.
_OPEN_WORD = re.compile(f"(?<![^\\W\\d_])[{_LATIN_OPEN}]+(?![^\\W\\d_])")
_BLANKS, _EDGES, _ENDS = re.compile("  +"), re.compile(" *\n *"), re.compile("\n{3,}")


def simplify(text: str) -> str:
    """Compatibility normalization and deletion of ignorable characters, in composed form; spaces in runs of one."""
    if not _PLAIN.fullmatch(text):
        if _SHAPED.search(text):
            text = _SHAPED.sub(lambda m: _KEEP[m[0]], text)
        text = unicodedata.normalize("NFC", text.replace("\r\n", "\n").translate(_SIMPLE)).translate(_BACK)
    if "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text:
        text = _ENDS.sub("\n\n", _EDGES.sub("\n", _BLANKS.sub(" ", text)))
    return text.strip(" \n")


def skeleton(text: str) -> str:
    """Cheap comparison form: simplified text with every look-alike as the first letter of its class. Not for readers."""
    text = simplify(text)
    if not _PLAIN.fullmatch(text):
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(REPRESENTATIVE))
    return text


class Reader:
    """Canonical forms under a table of character bigram counts (lower case, ``^`` before a word)."""

    def __init__(self, counts: dict[str, int]) -> None:
        before: Counter[str] = Counter()
        for pair, n in counts.items():
            before[pair[0]] += n
        self.score = {pair: math.log((n + FLOOR) / (before[pair[0]] + 50)) for pair, n in counts.items()}
        total = sum(before.values()) + 50
        self.unseen = math.log(FLOOR / total)
        self.seen: dict[str, str] = {}

    def _word(self, word: str) -> str:
        letters, marks = [], []
        for c in unicodedata.normalize("NFD", word):
            if unicodedata.combining(c) and letters:
                marks[-1] += c
            else:
                letters.append(c)
                marks.append("")
        columns = [GROUP.get(c, c) for c in letters]
        fixed = {script(c) for column in columns if len(column) == 1 for c in column} - {""}
        if len(fixed) == 1:  # a letter without look-alikes settles the script where it can
            (only,) = fixed
            columns = [next((c for c in column if script(c) == only), column) for column in columns]
        paths: list[tuple[float, str]] = [(0.0, "")]
        for column in columns:
            paths = [max(((s + self._step(p[-1] if p else "^", c), p + c) for s, p in paths), key=lambda x: (x[0], x[1])) for c in column]
        best = max(paths, key=lambda x: (x[0], x[1]))[1]
        return unicodedata.normalize("NFC", "".join(c + m for c, m in zip(best, marks)))

    def _step(self, a: str, b: str) -> float:
        s = self.score.get(a.lower() + b.lower(), self.unseen)
        return s + SWITCH * self.unseen if a != "^" and script(a) != script(b) else s

    def word(self, m: re.Match[str]) -> str:
        word = m[0]
        known = self.seen.get(word)
        if known is None:
            if len(self.seen) >= CACHED_WORDS:
                self.seen.clear()
            known = self.seen[word] = self._word(word)
        return known

    def read(self, text: str | None) -> str | None:
        """The consistent form of a text; null stays null, blank texts become empty."""
        if text is None:
            return None
        text = simplify(text)
        return (_OPEN_WORD if _PLAIN.fullmatch(text) else _WORD).sub(self.word, text)


def bigram_counts(df: DataFrame, text_column: str = "text") -> DataFrame:
    """``pair, n``: bigrams of lower-case Latin, Cyrillic and Greek letters over all texts, ``^`` before a word's first letter.

    Accents are dropped. The result is bounded by the alphabets (under 800 letters squared), not by the corpus.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        words: Counter[str] = Counter()
        pairs: Counter[str] = Counter()

        def flush() -> None:
            for word, n in words.items():
                base = [c for c in unicodedata.normalize("NFD", word) if script(c)]
                for a, b in zip(["^", *base], base):
                    pairs[a + b] += n
            words.clear()

        for batch in batches:
            for t in batch.column(0):
                if (text := t.as_py()) is not None:
                    words.update(_WORD.findall(simplify(text).lower()))
            if len(words) > 300_000:
                flush()
        flush()
        yield pa.RecordBatch.from_pydict({"pair": pa.array(list(pairs), pa.string()), "n": pa.array(list(pairs.values()), pa.int64())})

    slim = spread(df.select(text_column))
    return slim.mapInArrow(run, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


_READERS: dict[int, Reader] = {}


def canonical(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, text, canonical, form, look``: each text with its consistent form and 128-bit hashes of both.

    Null texts give nulls throughout, blank texts an empty form; repeated rows stay, other columns are ignored. Bigram
    counts are taken over all rows, collected (bounded by the alphabets) and broadcast.
    """
    counts = {r["pair"]: r["n"] for r in bigram_counts(df, text_column).collect()}
    held = df.sparkSession.sparkContext.broadcast(counts)
    key = held.id if hasattr(held, "id") else id(held)
    slim = df.select(id_column, text_column)
    schema = T.StructType([slim.schema[id_column], T.StructField("text", T.StringType()), T.StructField("canonical", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _READERS.get(key)
        if reader is None:
            _READERS.clear()
            reader = _READERS[key] = Reader(held.value)
        for batch in batches:
            texts = batch.column(1)
            read = pa.array([reader.read(t.as_py()) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, read], names=[id_column, "text", "canonical"])

    return spread(slim).mapInArrow(run, schema)


def look_classes(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, class_id, exact_id``: documents with equal ``class_id`` look the same, with equal ``exact_id`` are the same.

    Rows whose text is null or blank are left out.
    """
    read = canonical(df, id_column, text_column)
    return read.filter(F.length("canonical") > 0).select(id_column, F.md5("canonical").alias("class_id"), F.md5("text").alias("exact_id"))


def look_pairs(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id_1, doc_id_2``: pairs of rows, smaller id first, that look the same and differ in characters.

    Classes with a single spelling (groups of exact copies, however large) are dropped before the join by an aggregate
    with map-side combine; a class with two spellings gives only the pairs asked for, and adaptive execution splits it
    when it is large.
    """
    rows = Steps(df.sparkSession).next(look_classes(df, id_column, text_column))  # read three times
    mixed = rows.groupBy("class_id").agg(F.min("exact_id").alias("lo"), F.max("exact_id").alias("hi")).filter("lo <> hi").select("class_id")
    rows = rows.join(mixed, "class_id")
    a = rows.select("class_id", F.col(id_column).alias("doc_id_1"), F.col("exact_id").alias("exact_1"))
    b = rows.select("class_id", F.col(id_column).alias("doc_id_2"), F.col("exact_id").alias("exact_2"))
    pairs = a.join(b, "class_id").filter("doc_id_1 < doc_id_2 and exact_1 <> exact_2")
    return pairs.select("doc_id_1", "doc_id_2").distinct()
