"""Test items that stand in corpus documents (problem 9).

Method: a BM25 inverted index of the test items, in blocks with block-max impacts. Every passage (overlapping window) of
every document is a query. Each item has its own threshold, the least score that half of its words in one run can have;
impacts are divided by it, so that an item is a candidate from 1 on and no leaked item can score less. As in WAND, a
block is opened only if its upper bound over the query's terms reaches the threshold. Candidates are verified by an
alignment of words with up to two edits.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siktverk.llm.lookalike import skeleton
from siktverk.sources.tables import spread

#: Words of an item that may be altered or added without ending a run, and the share of an item that makes a leak.
EDITS, SHARE = 2, 0.5
#: Equal words that must follow an edit for it to be inside a run; fewer are chance.
STRETCH = 3
#: Items to a block of the index; items and words to one broadcast index, which is under 50 MB with so many.
BLOCK, PART, PART_WORDS = 8, 20_000, 1_000_000
#: The longest item of an index has at most so many times the words of the shortest, as windows are as long as the longest asks for.
LONGER = 2
K1, B = 1.2, 0.75

_BROKEN = re.compile("(?<=\\w)[-‐‑]\n\\s*(?=\\w)")
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    """Comparison words: look-alikes, case, punctuation, white space and words broken over lines do not count."""
    if not text:
        return []
    text = skeleton(text).lower()
    if "\n" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(text)


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all half-open ranges, one range after the other."""
    size = end - begin
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)


@dataclass
class Index:
    """BM25 impacts over thresholds, by term and block; see the module's docstring."""

    items: list[int]
    texts: list[list[int]]
    terms: dict[str, int]
    stride: int
    #: Postings by block: term t has rows at[t]:at[t+1] of (block, upper bound, begin, end in the postings by item).
    at: np.ndarray
    block: np.ndarray
    bound: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    item: np.ndarray
    impact: np.ndarray

    @staticmethod
    def build(rows: list[tuple[int, str | None]], share: float = SHARE, edits: int = EDITS) -> Index:
        items = sorted(((i, w) for i, t in rows if (w := words(t))), key=lambda x: (len(x[1]), x[0]))
        terms: dict[str, int] = {}
        texts = [[terms.setdefault(x, len(terms)) for x in w] for _, w in items]
        n = max(1, len(items))
        held = Counter(t for w in texts for t in set(w))
        mean = sum(map(len, texts)) / n
        postings: list[tuple[int, int, float]] = []
        stride = 1
        for k, w in enumerate(texts):
            impact = {t: math.log(1 + (n - held[t] + 0.5) / (held[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean)) for t, f in Counter(w).items()}
            half = math.ceil(share * len(w))
            least = math.inf
            for i in range(len(w) - half + 1):
                own = sorted(impact[t] for t in set(w[i : i + half]))
                least = min(least, sum(own[: max(1, len(own) - edits)]))
            postings += [(t, k, x / least * (1 + 1e-6)) for t, x in impact.items()]
            stride = max(stride, half + edits)
        postings.sort()
        item = np.array([k for _, k, _ in postings], dtype=np.int32)
        impacts = np.array([x for _, _, x in postings], dtype=np.float32)
        keys = [(t, k // BLOCK) for t, k, _ in postings]
        begins = [j for j, key in enumerate(keys) if not j or key != keys[j - 1]]
        ends = [*begins[1:], len(keys)] if begins else []
        at = np.zeros(len(terms) + 1, dtype=np.int64)
        for j in begins:
            at[keys[j][0] + 1] += 1
        return Index(
            [i for i, _ in items], texts, terms, stride, np.cumsum(at), np.array([keys[j][1] for j in begins], dtype=np.int32),
            np.array([impacts[a:b].max() for a, b in zip(begins, ends)], dtype=np.float32), np.array(begins, dtype=np.int64), np.array(ends, dtype=np.int64), item, impacts,
        )

    def candidates(self, passage: np.ndarray) -> list[int]:
        """Positions of all items that reach their threshold in a passage of distinct term ids."""
        rows = _ranges(self.at[passage], self.at[passage + 1])
        blocks = self.block[rows]
        upper = np.bincount(blocks, weights=self.bound[rows])
        rows = rows[upper[blocks] >= 1]
        if not len(rows):
            return []
        spans = _ranges(self.begin[rows], self.end[rows])
        scores = np.bincount(self.item[spans], weights=self.impact[spans])
        return np.flatnonzero(scores >= 1).tolist()

    def search(self, tokens: list[str]) -> dict[int, tuple[int, int]]:
        """Leaked items of a document: item id to (words of the item in the run, words of the item)."""
        known = [self.terms.get(w, -1) for w in tokens]
        found: dict[int, tuple[int, int]] = {}
        size = 2 * self.stride
        for start in range(0, max(1, len(known) - self.stride), self.stride):
            window = known[start : start + size]
            distinct = set(window)
            distinct.discard(-1)
            if not distinct:
                continue
            for k in self.candidates(np.fromiter(distinct, dtype=np.int64)):
                item = self.texts[k]
                region = known[max(0, start - len(item)) : start + size + len(item)]
                run = longest_run(item, region)
                if run >= SHARE * len(item) and run > found.get(self.items[k], (0, 0))[0]:
                    found[self.items[k]] = (run, len(item))
        return found


def longest_run(item: list[int], text: list[int], edits: int = EDITS, stretch: int = STRETCH) -> int:
    """Most item words held by one run of the text with at most ``edits`` words altered, added or left out.

    A run begins and ends with ``stretch`` equal words, and so many follow each edit or row of edits. Words that were altered or left
    out are not held: two sentences of one pattern with other contents would hold each other otherwise.
    """
    where: dict[int, list[int]] = {}
    for j, t in enumerate(text):
        if t >= 0:
            where.setdefault(t, []).append(j)
    n, m, best = len(item), len(text), 0
    done: set[tuple[int, int]] = set()
    for i in range(n):
        if n - i <= best:
            break
        for j in where.get(item[i], ()):
            if i and j and item[i - 1] == text[j - 1] or (i, j) in done:
                continue
            stack = [(i, j, edits, 0, 0)]
            reached: dict[tuple[int, int, bool], int] = {}
            while stack:
                a, b, left, got, spent = stack.pop()  # ``spent``: edits since the last equal word
                first = a
                while a < n and b < m and item[a] == text[b]:
                    a, b, got = a + 1, b + 1, got + 1
                whole = a - first >= stretch
                if whole:
                    best = max(best, got)
                # a row of edits goes on without equal words between them, or after a stretch of them
                if (whole or a == first and spent) and left and a < n and b < m and reached.get((a, b, whole), -1) < left:
                    reached[a, b, whole] = left
                    stack += [(a + 1, b + 1, left - 1, got, 1), (a, b + 1, left - 1, got, 1), (a + 1, b, left - 1, got, 1)]
            done.add((i, j))
    return best


def classes(rows: list[tuple[int, str | None]]) -> list[list[tuple[int, str | None]]]:
    """Items in groups of like length, ``LONGER`` from the shortest to the longest at most, with ``PART_WORDS`` words a group or one item."""
    sized = sorted(((len(words(t)), i, t) for i, t in rows), key=lambda x: x[:2])
    out: list[list[tuple[int, str | None]]] = []
    least = held = 0
    for n, i, t in sized:
        if not n:
            continue
        if not out or n > LONGER * least or held + n > PART_WORDS:
            out.append([])
            least, held = n, 0
        out[-1].append((i, t))
        held += n
    return out


def leaks(documents: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, item_id, run_words, item_words`` for every document that holds at least half of an item's words in one run.

    ``items`` (``item_id, text``) is the stated query set. It comes to the driver in parts of about ``PART`` items, by the hash of
    their ids, and each part is broadcast for a pass of its own over the documents, which are never moved: a part is all that the driver
    or a worker holds. Inside a part items of like length share an index, so that one long item does not make the windows of
    all others long. Null, empty and blank texts on either side match nothing; repeated documents are reported each; repeated items
    count once; other columns are ignored; empty tables give an empty result.
    """
    once = items.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    parts = max(1, -(-once.count() // PART))
    slim = documents.select(id_column, text_column)
    schema = T.StructType([T.StructField("doc_id", slim.schema[id_column].dataType), T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("run_words", T.IntegerType()), T.StructField("item_words", T.IntegerType())])
    out = None
    for k in range(parts):
        rows = once.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).collect()
        found = _found(spread(slim), sorted((r[0], r[1]) for r in rows), schema)
        out = found if out is None else out.unionByName(found)
    # an item under two texts may be found by each
    best = F.max(F.struct("run_words", "item_words")).alias("b")
    return out if len({r[0] for r in rows}) == len(rows) and parts == 1 else out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.run_words", "b.item_words")


def _found(slim: DataFrame, rows: list[tuple[int, str | None]], schema: T.StructType) -> DataFrame:
    held = slim.sparkSession.sparkContext.broadcast([Index.build(group) for group in classes(rows)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(0).type
            out: list[tuple[int, int, int, int]] = []
            for k, text in enumerate(batch.column(1)):
                if tokens := words(text.as_py()):
                    for index in held.value:
                        out += [(k, item, *run) for item, run in index.search(tokens).items()]
            if out:
                at, item, covered, size = zip(*out)
                ids = batch.column(0).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.cast(kind), pa.array(item), pa.array(covered, pa.int32()), pa.array(size, pa.int32())], names=["doc_id", "item_id", "run_words", "item_words"])

    return slim.mapInArrow(run, schema)
