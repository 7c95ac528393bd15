"""Encoding of a corpus by a public byte-level BPE vocabulary, and decoding.

The vocabulary file (``*.json`` with ``vocab`` and ``merges``) is read once on the driver and broadcast: its size
is that of the file, some 1.5 MB, whatever the corpus. Each pre-token is merged by a priority queue of merge ranks
over a doubly linked list of symbols; queue entries whose symbols have changed since are stale and are skipped, so
a pre-token of n bytes costs n log n. Null and empty texts give an empty list; strings of special tokens are
ordinary text; texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the public pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where vocabulary files are looked for unless a path is given.
TOKENIZER_DIR = os.environ.get("QUAYSIDE_TOKENIZERS", "/opt/tokenizers")
#: Pre-tokens kept with their ids in a worker, and the longest one kept.
CACHE_SIZE, CACHE_LENGTH = 100_000, 48


def byte_letters() -> list[str]:
    """The printable character by which byte-level vocabularies write each of the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return [letters[b] for b in range(256)]


class BytePairEncoder:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, source: str) -> None:
        model = json.loads(source)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = self.vocab
        #: (left id, right id) -> rank and id of the merged symbol
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        letters = byte_letters()
        self.byte_ids = [ids[x] for x in letters]
        number = {x: b for b, x in enumerate(letters)}
        self.strings = {i: bytes(number[c] for c in s) for s, i in ids.items() if all(c in number for c in s)}
        self.split = regex.compile(PATTERN).findall
        self.cache: dict[str, list[int]] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges, lowest rank first and leftmost first among equals."""
        n = len(symbols)
        ranks = self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        queue = []
        for i in range(n - 1):
            found = ranks.get((symbols[i], symbols[i + 1]))
            if found:
                queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, merged = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j >= n or symbols[i] != left or symbols[j] != right:
                continue  # stale: one of the two has been merged since
            symbols[i], alive[j] = merged, False
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = ranks.get((merged, symbols[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, merged, symbols[k], found[1]))
            h = before[i]
            if h >= 0:
                found = ranks.get((symbols[h], merged))
                if found:
                    heapq.heappush(queue, (found[0], h, symbols[h], merged, found[1]))
        return [s for s, live in zip(symbols, alive) if live]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        cache, byte_ids = self.cache, self.byte_ids
        for piece in self.split(text or ""):
            ids = cache.get(piece)
            if ids is None:
                ids = self.merge([byte_ids[b] for b in piece.encode("utf-8")])
                if len(piece) <= CACHE_LENGTH:
                    if len(cache) >= CACHE_SIZE:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int] | None) -> str:
        """The text of the ids: the vocabulary's strings joined, read as UTF-8; unknown ids give nothing."""
        return b"".join(self.strings.get(int(i), b"") for i in (() if ids is None else ids)).decode("utf-8", "replace")


_LOADED: dict[int, BytePairEncoder] = {}


def _encoder(shared: Broadcast) -> BytePairEncoder:
    """The worker's encoder, built once per process."""
    key = hash(shared.value)
    if key not in _LOADED:
        _LOADED[key] = BytePairEncoder(shared.value)
    return _LOADED[key]


def share_vocabulary(spark: SparkSession, name: str = "byte_bpe_50k", folder: str | None = None) -> Broadcast:
    """The vocabulary file as a broadcast; ``folder`` is a parameter, the default TOKENIZER_DIR."""
    with open(os.path.join(folder or TOKENIZER_DIR, f"{name}.json"), encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encode_column(shared: Broadcast, text: Column) -> Column:
    """array<int> of each text."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(shared)
        for batch in batches:
            yield batch.map(lambda t: encoder.encode(t if isinstance(t, str) else None))

    return encode(text)


def count_column(shared: Broadcast, text: Column) -> Column:
    """The number of ids of each text, without shipping the ids."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(shared)
        for batch in batches:
            yield batch.map(lambda t: len(encoder.encode(t if isinstance(t, str) else None))).astype("int32")

    return count(text)


def decode_column(shared: Broadcast, ids: Column) -> Column:
    """The text of each list of ids; null and empty lists give an empty text."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(shared)
        for batch in batches:
            yield batch.map(encoder.decode)

    return decode(ids)


def encode_documents(documents: DataFrame, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row; repeated rows stay repeated, an empty table gives an empty one."""
    shared = share_vocabulary(documents.sparkSession, name, folder)
    return documents.select("doc_id", encode_column(shared, F.col("text")).alias("ids"))


def round_trip(documents: DataFrame, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(doc_id, text) after encoding and decoding: the text again, and an empty one for a null."""
    shared = share_vocabulary(documents.sparkSession, name, folder)
    ids = documents.select("doc_id", encode_column(shared, F.col("text")).alias("ids"))
    return ids.select("doc_id", decode_column(shared, F.col("ids")).alias("text"))
