"""Corpus encoding with a public byte-level BPE vocabulary (problem 8).

Method: every pre-token is a doubly linked list of symbols. Buckets, one for each merge rank, hold the list positions
where that merge applies; a three-level bitmap over the ranks finds the lowest bucket in use with find-first-set.
Entries are never removed when a neighbour changes; they are skipped as stale when their bucket comes up. The work is
linear in the length of the pre-token, so pre-tokens of millions of bytes are encoded whole.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siktverk.sources.tables import spread

#: Fixed value: the pre-tokenization pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens up to this many characters are remembered by a worker, and so many of them; memory only, results do not depend on it.
CACHED_LENGTH, CACHED_TOKENS = 64, 200_000


class RankQueue:
    """Priority queue over merge ranks: three levels of 64-bit words over the ranks, and a list of positions per rank."""

    __slots__ = ("leaf", "mid", "top", "buckets")

    def __init__(self) -> None:
        self.leaf: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        self.leaf[word] = self.leaf.get(word, 0) | 1 << (rank & 63)
        self.mid[word >> 6] = self.mid.get(word >> 6, 0) | 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank in use with its positions from left to right, or None."""
        if not self.top:
            return None
        high = (self.top & -self.top).bit_length() - 1
        bits = self.mid[high]
        word = high << 6 | (bits & -bits).bit_length() - 1
        bits = self.leaf[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        if left := bits & bits - 1:
            self.leaf[word] = left
        else:
            del self.leaf[word]
            if left := self.mid[high] & ~(1 << (word & 63)):
                self.mid[high] = left
            else:
                del self.mid[high]
                self.top &= ~(1 << high)
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions


def merge(symbols: list[int], pairs: dict[int, int]) -> list[int]:
    """Symbols after all merges. ``pairs`` maps ``left << 32 | right`` to the merged id, and lower ids merge first."""
    n = len(symbols)
    if n < 2:
        return symbols
    if n == 2:
        one = pairs.get(symbols[0] << 32 | symbols[1])
        return symbols if one is None else [one]
    ids = list(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    queue = RankQueue()
    for i in range(n - 1):
        if (rank := pairs.get(ids[i] << 32 | ids[i + 1])) is not None:
            queue.push(rank, i)
    while (popped := queue.pop()) is not None:
        rank, positions = popped
        for i in positions:
            left = ids[i]
            j = after[i]
            if left < 0 or j >= n or pairs.get(left << 32 | ids[j]) != rank:
                continue  # stale: a symbol has gone or has changed
            k = after[j]
            ids[i], ids[j], after[i] = rank, -1, k
            if k < n:
                before[k] = i
                if (up := pairs.get(rank << 32 | ids[k])) is not None:
                    queue.push(up, i)
            if (h := before[i]) >= 0 and (up := pairs.get(ids[h] << 32 | rank)) is not None:
                queue.push(up, h)
    return [x for x in ids if x >= 0]


def read_pairs(path: str) -> np.ndarray:
    """Rows (left id, right id, merged id) of a ``.tiktoken`` rank file or a ``tokenizers`` JSON file, and the byte ids first.

    The first 256 rows give (byte, -1, id).
    """
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = model["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in printable}
        shown |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        rows = [(b, -1, vocabulary[shown[b]]) for b in range(256)]
        rows += [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        return np.array(rows, dtype=np.int64)
    ranks: dict[bytes, int] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    rows = [(b, -1, ranks[bytes([b])]) for b in range(256)]
    single = [ranks[bytes([b])] for b in range(256)]
    pairs: dict[int, int] = {}
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:  # the merge that makes a token joins the two symbols that all earlier merges leave of it
            parts = merge([single[b] for b in token], pairs)
            if len(parts) == 2:
                pairs[parts[0] << 32 | parts[1]] = rank
                rows.append((parts[0], parts[1], rank))
    return np.array(rows, dtype=np.int64)


class Encoder:
    """Encodes texts with the rows of :func:`read_pairs`. Strings of special tokens are ordinary text."""

    def __init__(self, rows: np.ndarray) -> None:
        self.bytes = [0] * 256
        for b, _, i in rows[:256].tolist():
            self.bytes[b] = i
        self.pairs = {a << 32 | b: i for a, b, i in rows[256:].tolist()}
        self.split = regex.compile(PATTERN).findall
        self.seen: dict[str, list[int]] = {}

    def token(self, text: str) -> list[int]:
        known = self.seen.get(text)
        if known is None:
            single = self.bytes
            known = merge([single[b] for b in text.encode("utf-8", "surrogatepass")], self.pairs)
            if len(text) <= CACHED_LENGTH:
                if len(self.seen) >= CACHED_TOKENS:
                    self.seen.clear()
                self.seen[text] = known
        return known

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            seen = self.seen
            for t in self.split(text):
                known = seen.get(t)
                out += self.token(t) if known is None else known
        return out


_ENCODERS: dict[str, Encoder] = {}


def _encoder(key: str, rows: np.ndarray) -> Encoder:
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(rows)
    return _ENCODERS[key]


def encode_corpus(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``id_column`` and ``ids`` (array of int) for every row.

    Null and empty texts give an empty list; blank texts are encoded like any other. Repeated rows stay repeated, other
    columns of ``df`` are ignored, and an empty table gives an empty result. The vocabulary (under 2 MB for any public
    one) is read on the driver and broadcast.
    """
    rows = df.sparkSession.sparkContext.broadcast(read_pairs(vocabulary))
    key = f"{vocabulary}:{os.path.getmtime(vocabulary)}"
    slim = df.select(id_column, text_column)
    schema = T.StructType([slim.schema[id_column], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, rows.value)
        for batch in batches:
            lists = [encoder.encode(t.as_py()) for t in batch.column(1)]
            ends = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(ends[-1]))
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_column, "ids"])

    return spread(slim).mapInArrow(run, schema)
