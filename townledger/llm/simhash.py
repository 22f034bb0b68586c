"""Near-duplicates by SimHash: fingerprints, generalised pigeonhole probing, verification, connected components.

1. Equal fingerprints are one node; a node is its fingerprint.
2. The 64 bits are dealt into four partitions, correlated bits together. Values of a partition are counted over all nodes: the
   table has at most 4 x 65,536 rows whatever the input.
3. If two fingerprints differ in at most r bits and the thresholds t_i of one of them satisfy sum(t_i + 1) = r + 1, the two differ
   in at most t_i bits of some partition i. Each node picks its own thresholds (-1: not probed) by dynamic programming on the counts.
4. A node is listed under its value of every partition and looks under all values within its thresholds. Lists that are long are
   dealt anew by four parts of the other 48 bits; what is still long is compared block by block.
5. A comparison gives out links that join components, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .near import components
from .shingles import lower_words

SHINGLE, SEED, BITS = 3, 42, 3
PARTS, WIDTH = 4, 16
# Sides of a list that are compared in one go, and the product of both sides from which a list is dealt anew.
BLOCK = 2048
LONG = BLOCK * BLOCK
# What a probe costs beside a comparison.
PROBE = 4


def majority(h: np.ndarray) -> int:
    """Number whose bits are set in over half of the 64-bit numbers."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    words = lower_words(text)
    if not words:
        return 0
    joined, k = b" ".join(words), min(k, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())], np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("fp"))


def _unpacked(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated_parts(pairs: np.ndarray, n: int) -> list[list[int]]:
    """Bits dealt into partitions, from how many of n nodes have both bits of a pair: next comes the bit most correlated with the partition."""
    mean = np.diag(pairs) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    tie = np.abs(pairs / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    left, parts = list(range(64)), []
    for _ in range(PARTS):
        part: list[int] = []
        for _ in range(WIDTH):
            among = part or left
            part.append(left.pop(max(range(len(left)), key=lambda i: (round(float(tie[left[i], among].sum()), 9), -left[i]))))
        parts.append(sorted(part))
    return parts


def _pair_counts(nodes: DataFrame) -> tuple[np.ndarray, int]:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((64, 64), np.int64), 0
        for pdf in parts:
            x = _unpacked(pdf["fp"].to_numpy()).astype(np.float64)
            total, n = total + (x.T @ x).astype(np.int64), n + len(x)
        yield pd.DataFrame({"at": np.arange(4097), "n": np.append(total.ravel(), n)})

    got = nodes.select("fp").mapInPandas(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(4097, np.int64)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out[:-1].reshape(64, 64), int(out[-1])


def values(fps: np.ndarray, parts: list[list[int]]) -> np.ndarray:
    """Value of every partition (rows) of every fingerprint."""
    bits = _unpacked(fps).astype(np.int64)
    return np.stack([bits[:, p] @ (1 << np.arange(len(p))) for p in parts])


def balls(bits: int = BITS) -> list[np.ndarray]:
    """For t = 0 … bits the patterns of a partition with at most t set bits."""
    out, found = [], [0]
    for t in range(bits + 1):
        found = found + [sum(1 << b for b in c) for c in combinations(range(WIDTH), t)] if t else found
        out.append(np.array(found, np.int64))
    return out


def reach(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(t, partition, value): nodes whose value of the partition differs from the value in at most t bits."""
    every = np.arange(1 << WIDTH)
    shells = [counts.copy()]
    for t, (small, large) in enumerate(zip(balls(bits), balls(bits)[1:])):
        shells.append(shells[-1] + sum(counts[:, every ^ p] for p in large[len(small):]))
    return np.stack(shells)


def thresholds(v: np.ndarray, table: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Thresholds (partition, node) of least cost with sum(t + 1) = bits + 1; the cost counts probes and the nodes they meet."""
    n = v.shape[1]
    sizes = [len(b) for b in balls(bits)]
    best = np.full((bits + 2, n), np.inf)
    best[0] = 0
    picks = []
    for i in range(PARTS):
        price = [np.zeros(n)] + [PROBE * sizes[t] + table[t, i, v[i]] for t in range(bits + 1)]
        options = np.full((bits + 2, bits + 2, n), np.inf)  # spent so far, spent here
        for b in range(bits + 2):
            for s in range(b + 1):
                options[b, s] = best[b - s] + price[s]
        pick = options.argmin(axis=1)
        best = np.take_along_axis(options, pick[:, None], 1)[:, 0]
        picks.append(pick)
    left, out = np.full(n, bits + 1), np.zeros((PARTS, n), np.int64)
    for i in range(PARTS - 1, -1, -1):
        spent = picks[i][left, np.arange(n)]
        out[i], left = spent - 1, left - spent
    return out


def _listed(nodes: DataFrame, share, bits: int) -> DataFrame:
    """(key, fp, kind): kind has bit 1 where a node is listed and bit 2 where it looks; lists without any node are not looked at."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, table = share.value
        around = balls(bits)
        for pdf in batches:
            fps = pdf["fp"].to_numpy()
            v = values(fps, parts)
            t = thresholds(v, table, bits)
            out = []
            for i in range(PARTS):
                found = [(v[i], fps, np.where(t[i] >= 0, 3, 1))]
                for r in range(1, bits + 1):
                    who = np.flatnonzero(t[i] == r)
                    seen = v[i][who, None] ^ around[r][None, 1:]
                    at, which = np.nonzero(table[0, i][seen] > 0)
                    found.append((seen[at, which], fps[who][at], np.full(len(at), 2)))
                out += [(x + (i << WIDTH), f, k) for x, f, k in found]
            key, fp, kind = zip(*out)
            yield pd.DataFrame({"key": np.concatenate(key), "fp": np.concatenate(fp), "kind": np.concatenate(kind).astype(np.int8)})

    return nodes.select("fp").mapInPandas(run, "key long, fp long, kind byte")


def _long(rows: DataFrame) -> DataFrame:
    """(key, listed, looking) of the lists where both sides together are more than one comparison."""
    return (rows.groupBy("key").agg(F.sum(F.col("kind").bitwiseAND(F.lit(1))).alias("listed"), F.sum((F.col("kind") >= 2).cast("long")).alias("looking"))
            .filter(f"listed * looking > {LONG} OR greatest(listed, looking) > {LONG}"))


def _links(rows: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) of rows (key, i, j, fp, kind); of the links inside one list as many are given out as join its components."""
    def joined(fp: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        listed, looking = np.unique(fp[kind & 1 > 0]), np.unique(fp[kind >= 2])
        nodes = np.union1d(listed, looking)
        label, own, other = np.arange(len(nodes)), np.searchsorted(nodes, looking), np.searchsorted(nodes, listed)
        for at in range(0, len(looking), 256):
            close = np.bitwise_count(looking[at:at + 256, None].view(np.uint64) ^ listed[None, :].view(np.uint64)) <= bits
            for r in np.flatnonzero(close.sum(axis=1) > 1 if len(listed) == len(nodes) else close.any(axis=1)):
                met = label[other[close[r]]]
                mine = label[own[at + r]]
                if (met != mine).any():
                    all_met = np.unique(np.append(met, mine))
                    label[np.isin(label, all_met)] = all_met[0]
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return nodes[label[moved]], nodes[moved]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            new = np.flatnonzero((np.diff(rest[["key", "i", "j"]].to_numpy(), axis=0) != 0).any(axis=1)) + 1
            if len(new):
                yield done(rest.iloc[:new[-1]], new[:-1])
                rest = rest.iloc[new[-1]:].reset_index(drop=True)
        if rest is not None:
            yield done(rest, np.zeros(0, np.int64))

    def done(pdf: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        fp, kind, out = pdf["fp"].to_numpy(), pdf["kind"].to_numpy(), []
        edges = [0, *cuts.tolist(), len(fp)]
        for lo, hi in zip(edges, edges[1:]):
            if hi - lo > 1:
                out.append(joined(fp[lo:hi], kind[lo:hi]))
        a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
        return pd.DataFrame({"a": a, "b": b})

    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "fp", "kind")
    return rows.mapInPandas(run, "a long, b long")


def _blocks(rows: DataFrame) -> DataFrame:
    """(key, i, j, fp, kind) of long lists (key, fp, kind, listed, looking): block i of those listed meets block j of those looking."""
    many = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")
    mine = lambda c: F.pmod(F.xxhash64("fp"), F.col(c)).cast("int")
    rows = rows.withColumn("rows", F.greatest(many("listed"), F.lit(1))).withColumn("cols", F.greatest(many("looking"), F.lit(1)))
    listed = rows.filter("kind <> 2").select("key", mine("rows").alias("i"), F.explode(F.expr("sequence(0, cols - 1)")).alias("j"), "fp", F.lit(1).cast("byte").alias("kind"))
    looking = rows.filter("kind >= 2").select("key", F.explode(F.expr("sequence(0, rows - 1)")).alias("i"), mine("cols").alias("j"), "fp", F.lit(2).cast("byte").alias("kind"))
    return listed.unionByName(looking)


def close_pairs(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) between fingerprints of ``nodes`` (fp, distinct) that join all that differ in at most ``bits`` bits."""
    sc = nodes.sparkSession.sparkContext
    parts = correlated_parts(*_pair_counts(nodes))

    @F.pandas_udf("array<int>")
    def value_of(fps: pd.Series) -> pd.Series:
        return pd.Series(list(values(fps.to_numpy(), parts).T.astype(np.int32)))

    got = nodes.select(F.posexplode(value_of("fp")).alias("part", "value")).groupBy("part", "value").count().toArrow()
    counts = np.zeros((PARTS, 1 << WIDTH), np.int64)
    counts[got["part"].to_numpy(), got["value"].to_numpy()] = got["count"].to_numpy()
    rows = cut_lineage(_listed(nodes, sc.broadcast((parts, reach(counts, bits))), bits))
    # at most PARTS x 65,536 keys
    first = cut_lineage(_long(rows))
    plain = rows.join(F.broadcast(first.select("key")), "key", "left_anti")
    # of a long list the remaining bits are dealt into parts again, equal in one of them at least
    rest = [[b for q in parts if q is not p for b in q] for p in parts]
    masks = [sum(1 << b for b in r[len(r) * k // (bits + 1):len(r) * (k + 1) // (bits + 1)]) for r in rest for k in range(bits + 1)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    of = F.array(*[F.lit(m).cast("long") for m in signed])
    again = rows.join(F.broadcast(first.select("key")), "key").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(bits))))
    mask = F.element_at(of, (F.shiftright("key", WIDTH) * (bits + 1) + F.col("k") + 1).cast("int"))
    again = again.select(F.xxhash64("key", "k", F.col("fp").bitwiseAND(mask)).alias("key"), "fp", "kind")
    second = cut_lineage(_long(again))
    short = plain.unionByName(again.join(second, "key", "left_anti")).select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "kind")
    return _links(short.unionByName(_blocks(again.join(second, "key"))), bits)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id.

    A bit of the fingerprint is set if it is set in over half of the XXH64 hashes of the three-word shingles, repeats included;
    a shorter text is one shingle, a null text or one without words has the fingerprint zero and is linked like any other.
    Documents are linked when their fingerprints differ in at most ``bits`` bits; the component's smallest id names it, null ids
    lose against any other, a component of null ids only has a null name. Repeated rows are rows of their own. Extra columns are
    not read; an empty table gives no rows. The result is exact: no candidates are dropped.
    """
    sig = cut_lineage(fingerprints(docs, id_col, text_col))
    nodes = cut_lineage(sig.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    root = cut_lineage(components(close_pairs(nodes.select("fp"), bits)))
    classes = nodes.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    label = classes.join(classes.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "component_id")
    return sig.join(label, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
