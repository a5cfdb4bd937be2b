"""Problem 6: encoding of a corpus with a public byte-level BPE vocabulary.

Method: contiguous rank array. A word is held as an array of part boundaries and an array with the rank of each pair
of adjacent parts. The smallest rank is looked up, the boundary between its two parts is deleted and the ranks of the
two neighbouring pairs are computed anew, until no pair is in the vocabulary. The arrays of a word of usual length are
short, so the scan is a single C-level ``min``. Words above ``LONG_WORD`` bytes (an unbroken run of a megabyte is
possible) take a heap over a linked list instead, which gives the same merges in O(n log n).

Each Python worker keeps the ids of the words it has seen as packed 32-bit integers, so a text costs one regular
expression pass, one dictionary lookup a word and one join of bytes. The memory of that cache is bounded by
``CACHE_WORDS``; the vocabulary itself (50,256 entries, a fixed size) is the only broadcast.

Defined cases: null, empty and blank texts. A null text and an empty text have an empty list of ids; a blank text has
the ids of its white space. Strings that look like special tokens are ordinary text. Unpaired surrogates cannot occur in
Spark strings. The result holds only the key and the ids (or their number); further columns of the input, whatever
their names, are not read.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the public vocabularies; ``spark.plumbline.tokenizers`` or the argument ``folder`` override it.
DEFAULT_FOLDER = "/opt/tokenizers"
FOLDER_CONF = "spark.plumbline.tokenizers"

#: Fixed value: the pattern that splits text before the merges of this vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words of more bytes are merged with a heap.
LONG_WORD = 400
#: Words (of at most ``CACHED_LENGTH`` characters) whose ids a worker keeps.
CACHE_WORDS = 200_000
CACHED_LENGTH = 64

_NONE = 1 << 30


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word by the contiguous rank array."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    bounds = list(range(len(piece) + 1))
    pair = [ranks.get(piece[i : i + 2], _NONE) for i in range(len(piece) - 1)]
    get = ranks.get
    while pair:
        low = min(pair)
        if low == _NONE:
            break
        i = pair.index(low)
        del bounds[i + 1]
        del pair[i]
        if i < len(pair):
            pair[i] = get(piece[bounds[i] : bounds[i + 2]], _NONE)
        if i:
            pair[i - 1] = get(piece[bounds[i - 1] : bounds[i + 1]], _NONE)
    return [ranks[piece[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a word of any length: a heap of (rank, start) over linked parts."""
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts at i; 0 when i is no longer a start
    before = list(range(-1, n))  # start of the part that ends at i
    heap = []

    def push(start: int) -> None:
        middle = end[start]
        if middle < n:
            rank = ranks.get(piece[start : end[middle]])
            if rank is not None:
                heapq.heappush(heap, (rank, start, middle, end[middle]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, start, middle, stop = heapq.heappop(heap)
        if end[start] != middle or middle >= n or end[middle] != stop:
            continue  # one of the two parts has been merged since
        end[start], end[middle] = stop, 0
        before[stop] = start
        push(start)
        if start:
            push(before[start])
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


def fast_splitter() -> Callable[[str], list[str]]:
    """``SPLIT`` for the standard library's ``re``, which is twice as fast but knows no ``\\p``.

    The classes are spelled out for the Basic Multilingual Plane (where ``re`` tests them in constant time); texts with
    characters beyond it take ``regex``.
    """
    import regex

    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def members(what: str) -> str:
        return "".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for m in regex.finditer(f"{what}+", plane))

    letter, number, space = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    pattern = SPLIT.replace(r"(?!\S)", f"(?![^{space}])").replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]")
    pattern = pattern.replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]").replace(r"\s", f"[{space}]")
    usual, beyond, any_plane = re.compile(pattern).findall, re.compile("[\U00010000-\U0010ffff]").search, regex.compile(SPLIT).findall
    return lambda text: usual(text) if text.isascii() or not beyond(text) else any_plane(text)


class Encoder(dict):
    """Maps a word to the packed ids of its parts; texts are encoded through it."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.find = fast_splitter()

    def __missing__(self, word: str) -> bytes:
        piece = word.encode("utf-8")
        ids = (merge_short if len(piece) <= LONG_WORD else merge_long)(piece, self.ranks)
        packed = b"".join([i.to_bytes(4, "little") for i in ids])
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = packed
        return packed

    def packed(self, text: str | None) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        return b"".join(map(self.__getitem__, self.find(text))) if text else b""

    def ids(self, text: str | None) -> list[int]:
        return list(memoryview(self.packed(text)).cast("i"))


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def vocabulary(spark: SparkSession, name: str = "byte_bpe_50k", folder: str | None = None) -> Broadcast:
    """The bytes of the vocabulary file, read on the driver and broadcast (below 1 MB)."""
    folder = folder or spark.conf.get(FOLDER_CONF, DEFAULT_FOLDER)
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as file:
        return spark.sparkContext.broadcast(file.read())


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(raw: bytes) -> Encoder:
    """The encoder of this worker process for a vocabulary file."""
    key = hash(raw)
    if key not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        _ENCODERS[key] = Encoder(ranks)
    return _ENCODERS[key]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``key`` and ``ids array<int>`` of each row of ``df``. No shuffle; one pass over the column."""
    raw = vocabulary(df.sparkSession, name, folder)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = encoder_of(raw.value).packed
        for batch in batches:
            rows = [packed(t) for t in batch.column(1).to_pylist()]
            offsets = [0]
            for r in rows:
                offsets.append(offsets[-1] + len(r) // 4)
            values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(rows))])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, schema)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", as_name: str = "n_tokens", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """The columns ``keep`` and the number of tokens of ``text`` (0 for null). Only the number leaves the worker."""
    raw = vocabulary(df.sparkSession, name, folder)
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(as_name, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = encoder_of(raw.value).packed
        for batch in batches:
            last = batch.num_columns - 1
            n = pa.array([len(packed(t)) // 4 for t in batch.column(last).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], n], names=[*keep, as_name])

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)
