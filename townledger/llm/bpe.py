"""Byte-level BPE in two tiers: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for all others."""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Pre-tokens remembered by a worker; beyond that the memory is emptied and filled anew.
REMEMBERED = 500_000
LONGEST_REMEMBERED = 64
# Prime above 2^32: displaced hashes run through all residues before they are cut to a slot.
FIELD = 4294967311


class PerfectHash:
    """Minimal perfect hash of byte strings by displacement: n keys, n slots, no empty slot."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        hashes = [self._halves(k) for k in keys]
        groups: dict[int, list[int]] = {}
        for i, (a, _, _) in enumerate(hashes):
            groups.setdefault(a % self.buckets, []).append(i)
        self.shift = [0] * self.buckets
        self.slot_of: list[int] = [-1] * n  # key at slot
        free = 0
        for bucket, members in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            if len(members) == 1:  # the rest goes straight to the free slots
                while self.slot_of[free] >= 0:
                    free += 1
                self.shift[bucket], self.slot_of[free] = -free - 1, members[0]
                continue
            d = 0
            while True:
                slots = [(hashes[i][1] + d * hashes[i][2]) % FIELD % n for i in members]
                if len(set(slots)) == len(slots) and all(self.slot_of[s] < 0 for s in slots):
                    break
                d += 1
            self.shift[bucket] = d
            for s, i in zip(slots, members):
                self.slot_of[s] = i

    @staticmethod
    def _halves(key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFF, (h >> 64) & 0xFFFFFFF | 1

    def slot(self, key: bytes) -> int:
        """The slot of a key; one outside the set gets some slot, so the key there must be compared."""
        a, b, c = self._halves(key)
        d = self.shift[a % self.buckets]
        return -d - 1 if d < 0 else (b + d * c) % FIELD % self.n


class _Seen(dict):
    """Pre-tokens met before; emptied when full, so that a worker's memory stays bounded."""

    def __init__(self, work):
        super().__init__()
        self.work = work

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.work(piece)
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: lowest rank first, leftmost among equals; parts are linked by their ends."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = end[i]
        if j < 0 or j >= n or end[j] != e:  # one of the two parts has changed since
            continue
        end[i], end[j] = e, -1
        if e < n:
            before[e] = i
            if (r := ranks.get(piece[i:end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:e])) is not None:
            heapq.heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder over one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.keys = [keys[i] for i in self.hash.slot_of]
        self.ids = [ranks[k] for k in self.keys]
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.seen = _Seen(self.piece)

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one pre-token: the perfect hash first, the heap if the pre-token is not in the vocabulary."""
        key = text.encode()
        s = self.hash.slot(key)
        return (self.ids[s],) if self.keys[s] == key else tuple(merge_bytes(key, self.ranks))

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.seen.__getitem__, self.find(text))), np.int32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def load_ranks(path: str) -> bytes:
    """The rank file as it is; a vocabulary has a fixed size, so the driver may hand it to every task."""
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(maxsize=2)
def _codec(data: bytes, pattern: str) -> Codec:
    return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text, without special tokens.

    A null or empty text has no ids. Ids and repeated rows are passed on one by one; extra columns are not read; an empty
    table gives no rows. ``path`` names a rank file on the driver.
    """
    share = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(share.value, pattern)
        for s in parts:
            yield pd.Series([codec.encode(t) for t in s], dtype=object)

    return docs.select(F.col(id_col).alias("doc_id"), run(F.coalesce(F.col(text_col), F.lit(""))).alias("ids"))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``decoded``: the bytes of ``ids``; null ids give no bytes."""
    share = encoded.sparkSession.sparkContext.broadcast(load_ranks(path))

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(share.value, pattern)
        for s in parts:
            yield pd.Series([codec.decode(np.asarray(x)) for x in s], dtype=object)

    return encoded.withColumn("decoded", run(F.coalesce("ids", F.array().cast("array<int>"))))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; null counts as empty."""
    df = decode(encode(docs, path, pattern, id_col, text_col), path, pattern)
    return df.select("doc_id", *["ids"] * keep_ids, F.size("ids").cast("long").alias("n_tokens"),
                     F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"), 256).alias("ids_sha256"),
                     F.sha2("decoded", 256).alias("decoded_sha256"))
