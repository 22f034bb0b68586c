"""Hard negatives by lists that clusters of anchors share.

1. Anchors are put into clusters by angle; a cluster knows the greatest angle between its centre and a member.
2. Each cluster has one list of all rows, sorted by an upper bound of the inner product with any member of norm one: the row's norm
   times the cosine of its angle to the centre less the cluster's greatest angle. The order is settled once, as a table of counts
   by bound, which cuts the list into segments.
3. Members walk the segments in order. A member is done once what it has found lies above all bounds of the rest; clusters
   without unfinished members read no further segments.
4. A segment is dealt into blocks of rows and a cluster into groups of members; a task compares one block with one group.

The centres are fitted on a bounded sample of anchors; they only decide how early a walk ends, the result is exact with any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F, Window

from .common import cut_lineage, stored

# Anchors that the centres are fitted on, anchors wanted in a cluster, and clusters at most.
SAMPLE, CLUSTER, CLUSTERS = 4096, 256, 64
GROUP, BLOCK = 512, 2048
# Shares of a list after which its segments end.
SEGMENTS = (1 / 64, 1 / 8)
# Relative room for rounding in a bound.
ROOM = 1e-6


def matrix(vectors, width: int = 0) -> np.ndarray:
    """Rows floor(256 x) in double; shorter vectors are filled with zeros."""
    vectors = list(vectors)
    out = np.zeros((len(vectors), max([width, *map(len, vectors)])))
    for i, x in enumerate(vectors):
        out[i, :len(x)] = x
    return np.floor(256.0 * out)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; Python's integers where doubles could round."""
    if min(a.shape + b.shape) == 0:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2 ** 53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return whole(a) @ whole(b).T


def best(score: np.ndarray, none: np.ndarray, ids: np.ndarray, where: np.ndarray, k: int | None = None) -> np.ndarray:
    """Of the places ``where`` the first k by score descending, then id ascending, null ids last."""
    s = score[where]
    if k is not None and len(s) > 4 * k and s.dtype != object:
        where = where[s >= np.partition(s, len(s) - k)[len(s) - k]]
        s = score[where]
    if s.dtype == object:
        order = sorted(range(len(s)), key=lambda i: (-s[i], none[where[i]], ids[where[i]]))
    else:
        order = np.lexsort((ids[where], none[where], -s))
    return where[np.asarray(order, np.int64)[:k]]


def centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Directions of k clusters by spherical k-means."""
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[near == i].sum(axis=0) for i in range(k)])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-300), c)
    return c


def angles(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to the centres; a row without direction has the angle 0."""
    c = np.pad(c, ((0, 0), (0, max(0, x.shape[1] - c.shape[1]))))
    norm = np.linalg.norm(x, axis=1)
    cos = (x / np.where(norm > 0, norm, 1)[:, None]) @ c.T / np.maximum(np.linalg.norm(c, axis=1), 1e-300)
    return norm, np.where(norm[:, None] > 0, np.arccos(np.clip(cos, -1, 1)), 0.0)


def upper_bounds(x: np.ndarray, c: np.ndarray, widest: np.ndarray) -> np.ndarray:
    """(row, cluster): bound of the inner product with members of norm one."""
    norm, angle = angles(x, c)
    return norm[:, None] * (np.cos(np.maximum(0.0, angle - widest)) + ROOM)


def rung(bound: np.ndarray) -> np.ndarray:
    """Place on a ladder of numbers with steps of half a per cent at most, in the order of the numbers."""
    x = np.ascontiguousarray(bound, np.float64).view(np.int64)
    return (x ^ ((x >> 63) & 0x7FFFFFFFFFFFFFFF)) >> 44


def rung_floor(r: int) -> float:
    """Least number on a rung, above which no number of a lower rung lies."""
    x = np.array([r << 44], np.int64)
    return float((x ^ ((x >> 63) & 0x7FFFFFFFFFFFFFFF)).view(np.float64)[0])


def _prepared(df: DataFrame, id_col: str, label_col: str, vector_col: str, relabel: int) -> DataFrame:
    v = F.col(vector_col)
    out = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * 256) == float("inf"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", out)).dropDuplicates(["id", "label", "v"])
    moved = F.when(F.col("id") % relabel == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select(F.monotonically_increasing_id().alias("r"), F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("none"), moved.alias("label"), "v")
    return stored(rows, "vectors")


class Lists:
    """Where the segments of every cluster's list begin and how many rows they hold."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, c: np.ndarray):
        self.rows, self.c = rows, c
        info = {x["cluster"]: x for x in anchors.groupBy("cluster").agg(F.count("*").alias("n"), F.max("angle").alias("widest")).collect()}
        self.widest = np.array([info[k]["widest"] if k in info else 0.0 for k in range(len(c))])
        self.groups = [-(-info[k]["n"] // GROUP) if k in info else 0 for k in range(len(c))]
        widest = self.widest

        def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                b = rung(upper_bounds(matrix(pdf["v"], c.shape[1]), c, widest))
                for k in range(len(c)):
                    at, n = np.unique(b[:, k], return_counts=True)
                    yield pd.DataFrame({"cluster": k, "at": at, "n": n})

        got = rows.select("v").mapInPandas(count, "cluster int, at long, n long").groupBy("cluster", "at").agg(F.sum("n").alias("n")).toPandas()
        self.low, self.size = [], []  # (cluster, segment)
        for k in range(len(c)):
            mine = got[got["cluster"] == k].sort_values("at", ascending=False)
            at, n = mine["at"].to_numpy(), mine["n"].to_numpy().cumsum()
            ends = [int(np.searchsorted(n, n[-1] * share)) for share in SEGMENTS] + [len(n) - 1] if len(n) else [0] * (len(SEGMENTS) + 1)
            self.low.append([int(at[e]) if len(n) else 0 for e in ends])
            self.size.append(np.diff([0, *[int(n[e]) for e in ends]]).tolist() if len(n) else [0] * len(ends))

    def blocks(self, segment: int) -> list[int]:
        return [-(-s[segment] // BLOCK) for s in self.size]

    def rest(self, segment: int) -> list[float]:
        """Bound of what follows a segment."""
        return [rung_floor(x[segment]) if segment < len(SEGMENTS) else float("-inf") for x in self.low]

    def segment(self, segment: int, clusters: list[int]) -> DataFrame:
        """(cluster, block, r, id, none, label, v) of one segment of the lists of some clusters."""
        c, widest, blocks = self.c, self.widest, self.blocks(segment)
        low, high = [x[segment] for x in self.low], [x[segment - 1] if segment else None for x in self.low]

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                b = rung(upper_bounds(matrix(pdf["v"], c.shape[1]), c, widest))
                r = pdf["r"].to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                for k in clusters:
                    here = np.flatnonzero((b[:, k] >= low[k]) & ((b[:, k] < high[k]) if high[k] is not None else True))
                    if len(here):
                        out = pdf.iloc[here].copy()
                        out.insert(0, "cluster", k)
                        out.insert(1, "block", ((r[here] >> np.uint64(33)) % np.uint64(blocks[k])).astype(np.int32))
                        yield out

        kind = dict(self.rows.dtypes)["v"]
        return self.rows.select("r", "id", "none", "label", "v").mapInPandas(run, f"cluster int, block int, r long, id long, none boolean, label long, v {kind}")


def _of(values: list, kind: str) -> Column:
    """The entry of a short list for the row's cluster."""
    return F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster") + 1)


def _walk(lists: Lists, anchors: DataFrame, wants: DataFrame, same: bool, low: int, k: int) -> DataFrame:
    """(a, slot, id, none, score): the first k rows for every want (a, slot, top), top being the greatest score allowed, null for any."""
    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            width = max(len(x) for side in (left["v"], right["v"]) for x in side)
            scores = inner(matrix(left["v"], width), matrix(right["v"], width))
            ids, none, label, r = (right[c].to_numpy() for c in ("id", "none", "label", "r"))
            for i, (a, mine, goals) in enumerate(zip(left["a"].tolist(), left["label"].tolist(), left["goals"])):
                s, ok = scores[i], ((label == mine) & (r != a) if same else label != mine)
                goals = [(g["slot"], g["top"], g["floor"]) for g in goals]
                if not same:
                    ok &= (100 * s >= low * min(t for _, t, _ in goals)) & (s <= max(t for _, t, _ in goals))
                    found = best(s, none, ids, np.flatnonzero(ok))
                for slot, top, floor in goals:
                    if same:
                        hits = best(s, none, ids, np.flatnonzero(ok & (s >= floor) if floor is not None else ok), k)
                    else:
                        x = s[found]
                        hits = found[(x <= top) & (100 * x >= low * top) & ((x >= floor) if floor is not None else True)][:k]
                    out += [(a, slot, ids[h], none[h], s[h]) for h in hits]
        return pd.DataFrame(out, columns=["a", "slot", "id", "none", "score"])

    first = Window.partitionBy("a", "slot").orderBy(F.desc("score"), "none", "id")
    found = None
    wants = cut_lineage(wants.withColumn("floor", F.lit(None).cast("long")))
    for segment in range(len(SEGMENTS) + 1):
        members = cut_lineage(anchors.join(wants.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("slot", "top", "floor"))).alias("goals")), "a"))
        active = sorted(x["cluster"] for x in members.select("cluster").distinct().collect())
        if not active:
            break
        blocks = [max(1, n) for n in lists.blocks(segment)]
        left = members.select("cluster", "g", F.explode(F.sequence(F.lit(0), _of(blocks, "int") - 1)).alias("block"), "a", "label", "goals", "v")
        right = lists.segment(segment, active).withColumn("g", F.explode(F.sequence(F.lit(0), _of([max(1, n) for n in lists.groups], "int") - 1)))
        key = ("cluster", "g", "block")
        new = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(match, "a long, slot int, id long, none boolean, score long")
        new = new if found is None else found.unionByName(new)
        found = cut_lineage(new.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k).drop("n"))
        have = found.groupBy("a", "slot").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        rest = F.col("norm") * _of(lists.rest(segment), "double")
        open_ = (F.coalesce("n", F.lit(0)) < k) | (F.col("least") <= rest)
        if not same:
            open_ &= 100 * rest >= low * F.col("top")
        wants = wants.drop("floor").join(anchors.select("a", "cluster", "norm"), "a").join(have, ["a", "slot"], "left").filter(open_)
        wants = cut_lineage(wants.select("a", "slot", "top", F.when(F.col("n") >= k, F.col("least")).alias("floor")))
    return found


def hard_negatives(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", every: int = 100, relabel: int = 7,
                   positives: int = 5, negatives: int = 5, low: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor and positive.

    Anchors are the rows whose id is divisible by ``every``, positives the first others of the anchor's label, negatives the first
    rows of other labels whose score lies between ``low`` per cent of the positive's and the positive's. Scores are exact inner
    products of the components floor(256 x), higher ones first, ties by smaller id, a null id last. Where an id is divisible by
    ``relabel``, its label first becomes (label + 1) % 10. Rows with a null label, a null vector or a component that is null or
    not finite (256 times it included) take no part. Rows equal in id, label and vector count once; rows that share an id and differ are rows of their
    own. Vectors of different lengths are filled with zeros. A score beyond 64 bits ends the job with an error. A positive of
    negative score has no negatives. Extra columns are not read; an empty table or one without anchors gives no rows.
    """
    rows = _prepared(df, id_col, label_col, vector_col, relabel)
    plain = rows.filter(f"NOT none AND id % {every} = 0")
    n = plain.count()
    sample = plain.orderBy(F.xxhash64("id", "r")).limit(SAMPLE).select("v").toPandas()["v"]
    x = matrix(sample, 1)
    c = centres(x, min(max(1, -(-n // CLUSTER)), CLUSTERS)) if n else np.zeros((1, 1))

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            norm, angle = angles(matrix(pdf["v"], c.shape[1]), c)
            near = angle.argmin(axis=1)
            yield pdf.assign(cluster=near.astype(np.int32), norm=norm, angle=angle[np.arange(len(pdf)), near])

    kind = dict(rows.dtypes)["v"]
    anchors = cut_lineage(plain.select("r", "id", "label", "v").mapInPandas(assign, f"r long, id long, label long, v {kind}, cluster int, norm double, angle double"))
    lists = Lists(rows, anchors, c)
    anchors = cut_lineage(anchors.withColumn("g", F.pmod(F.xxhash64("r"), _of([max(1, g) for g in lists.groups], "int")).cast("int")).withColumnRenamed("r", "a"))
    wants = anchors.select("a", F.lit(0).alias("slot"), F.lit(None).cast("long").alias("top"))
    schema = "a long, slot int, id long, none boolean, score long"
    mine = _walk(lists, anchors, wants, True, low, positives) if n else df.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("a").orderBy(F.desc("score"), "none", "id")
    mine = cut_lineage(mine.withColumn("slot", F.row_number().over(order))) if n else mine
    wants = mine.filter("score >= 0").select("a", "slot", F.col("score").alias("top"))
    theirs = _walk(lists, anchors, wants, False, low, negatives) if n else None
    theirs = df.sparkSession.createDataFrame([], schema) if theirs is None else theirs
    theirs = theirs.withColumn("rank", F.row_number().over(Window.partitionBy("a", "slot").orderBy(F.desc("score"), "none", "id")))
    named = lambda none, i: F.when(~F.col(none), F.col(i))
    left = mine.select("a", "slot", named("none", "id").alias("positive_id"), F.col("score").alias("positive_score"))
    right = theirs.select("a", "slot", "rank", named("none", "id").alias("negative_id"), F.col("score").alias("negative_score"))
    return (left.join(right, ["a", "slot"]).join(anchors.select("a", F.col("id").alias("anchor_id")), "a")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


SQL = """
WITH v AS (SELECT DISTINCT vec_id, label, embedding FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
           AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))), false)),
q AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM v),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM q a JOIN q b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT a, anchor_id, id, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST) AS slot FROM s WHERE same) WHERE slot <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.a, p.slot ORDER BY s.score DESC, s.id NULLS LAST) AS rank
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
