"""Near-duplicates: SuperMinHash signatures, banding, verification on full shingle sets, connected components.

Documents with the same shingle set are one node. In each bucket all nodes are compared with the smallest one only; what stays
unresolved (a bucket whose nodes lie in several components) is narrowed by the triangle inequality of the Jaccard distance. Small
buckets are then compared pairwise; nodes of large ones are counted against each other block by block through an inverted index,
which gives out links between components only. No bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F, Window

from .common import cut_lineage, flag_ids, has_rows, id_filter
from .shingles import GOLD, forget_words, mix, shingle_set, step

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4
SMALL_BUCKET = 48
BLOCK = 256
EDGES = 500_000
ELEMENTS = 4096


def super_minhash(items: np.ndarray, m: int, seed: int = 0) -> np.ndarray:
    """SuperMinHash of distinct 64-bit items: component p gets the least r + rank over items, rank being p's place in the
    item's own permutation. Ranks are worked through in order; once all components lie below a rank, later ranks cannot win.
    """
    best = np.full(m, np.inf)
    for start in range(0, len(items), ELEMENTS):
        part = mix(items[start:start + ELEMENTS] + step(seed))
        perm = np.tile(np.arange(m, dtype=np.int16), (len(part), 1))
        row = np.arange(len(part))
        for j in range(m):
            if best.max() <= j:
                break
            x = mix(part + step(j + 1))
            k = j + (mix(x) % np.uint64(m - j)).astype(np.int64)
            here, p = perm[:, j].copy(), perm[row, k]
            perm[row, k] = here
            np.minimum.at(best, p, (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 + j)
    return best


def band_hashes(items: np.ndarray, seed: int = 0, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    sig = super_minhash(items, bands * rows, seed).view(np.uint64).reshape(bands, rows)
    acc = np.arange(bands, dtype=np.uint64) + np.uint64(seed * bands + 1)
    for c in range(rows):
        acc = mix(acc * GOLD + sig[:, c])
    return acc.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, node, bands): node names the shingle set, null for a document without words."""
    @F.pandas_udf("n_shingles long, node binary, bands array<long>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            sets = [shingle_set(t, SHINGLE) for t in texts]
            yield pd.DataFrame({"n_shingles": [len(s) for s in sets],
                                "node": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                                "bands": [band_hashes(s) if len(s) else None for s in sets]})
        forget_words()

    return docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("s")).select("doc_id", "s.*")


def _sets(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, items) of the given representatives (node, digest, rep); only texts that may be needed are read into Python."""
    @F.pandas_udf("items array<long>, name binary")
    def read(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            sets = [shingle_set(t, SHINGLE) for t in texts]
            yield pd.DataFrame({"items": [s.view(np.int64) for s in sets], "name": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]})
        forget_words()

    texts = flag_ids(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), id_filter(reps, F.col("rep")), F.col("id")).filter("_maybe")
    texts = texts.select("id", read("text").alias("s")).select("id", "s.items", "s.name")
    # joined on the name alone, so that repeated rows meet in the same partition
    return texts.join(reps, (F.col("name") == F.col("digest")) & F.col("id").eqNullSafe(F.col("rep"))).groupBy("node").agg(F.first("items").alias("items"))


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, either) of pairs of nodes, counted on the full sets; only sets that may be needed are moved."""
    @F.pandas_udf("long")
    def shared(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y)])

    pairs = cut_lineage(pairs)
    needed = flag_ids(sets, id_filter(pairs.select(F.explode(F.array("a", "b")).alias("x")), F.col("x")), F.col("node")).filter("_maybe")
    df = (pairs.join(needed.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
          .join(needed.select(F.col("node").alias("a"), F.col("items").alias("x")), "a"))
    return (df.select("a", "b", shared("x", "y").alias("common"), (F.size("x") + F.size("y")).cast("long").alias("both"))
            .select("a", "b", "common", (F.col("both") - F.col("common")).alias("either")))


def _contract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the edges (u, v) of one partition; gives every node of it with the smallest node it reaches there."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[y]
        return x

    for pdf in parts:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            p, q = top(u), top(v)
            if p != q:
                parent[max(p, q)] = min(p, q)
    out = [(top(x), x) for x in list(parent) if top(x) != x]
    yield pd.DataFrame(out, columns=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that can be reached.

    Edges are contracted by union-find inside partitions of about EDGES edges, then between them by a large-star and a small-star
    step, until nothing changes; every step leaves at most as many edges as before. Where one partition holds all edges the
    first contraction is the answer.
    """
    cur = cut_lineage(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        size = cur.count() // EDGES + 1
        cur = cut_lineage(cur.coalesce(size).mapInPandas(_contract, "u long, v long"))
        if size > 1:
            both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = both.filter("v > u").join(low, "u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
            low = large.groupBy("v").agg(F.min("u").alias("m"))
            joined = large.join(low, "v")
            small = joined.select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(joined.select(F.col("m").alias("u"), "v")).filter("u <> v").distinct()
            cur = cut_lineage(small)
            state = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if size == 1 or state == before:
            return (cur.select(F.col("v").alias("node"), F.col("u").alias("root"))
                    .unionByName(cur.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct())
        before = state


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    return pairs.filter(f"100 * common >= {percent} * either").select("a", "b")


def _block_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b, common, either) between nodes (key, node, root) of large buckets that lie in different components.

    Buckets that share nodes are one group, so a node is worked on once and not once per band. Groups are cut into blocks of
    about BLOCK nodes, and every pair of blocks is a task of its own: bounded memory, no pair is ever a row. Of the links between
    the same components one is enough.
    """
    first = rows.withColumn("a", F.min("node").over(Window.partitionBy("key"))).select("a", F.col("node").alias("b")).distinct()
    group = cut_lineage(components(first)).withColumnRenamed("root", "g")
    nodes = rows.select("node", "root").distinct().join(group, "node")
    counts = nodes.groupBy("g").agg(F.count("*").alias("m"))
    nodes = (nodes.join(counts, "g").withColumn("blocks", (F.floor((F.col("m") - 1) / BLOCK) + 1).cast("int"))
             .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(sets, "node"))
    each = (nodes.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
            .select("g", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "root", "mine", "items"))

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        nodes, mine = pdf["node"].to_numpy(), pdf["mine"].to_numpy()
        names, root = np.unique(pdf["root"].to_numpy(), return_inverse=True)
        arrays = [np.asarray(x, np.int64) for x in pdf["items"]]
        sizes = np.array([len(x) for x in arrays])
        items, inverse = np.unique(np.concatenate(arrays), return_inverse=True)
        owner = np.repeat(np.arange(len(arrays)), sizes)
        order = np.argsort(inverse, kind="stable")
        posting = owner[order]
        start = np.searchsorted(inverse[order], np.arange(len(items) + 1))
        ends, out, met = np.cumsum(sizes), [], {}

        def top(x):
            while met.setdefault(x, x) != x:
                x = met[x]
            return x

        for x in np.flatnonzero(mine == i):
            own = inverse[ends[x] - sizes[x]:ends[x]]
            common = np.bincount(np.concatenate([posting[start[k]:start[k + 1]] for k in own]), minlength=len(arrays))
            either = sizes[x] + sizes - common
            for y in np.flatnonzero((100 * common >= percent * either) & (root != root[x]) & ((mine == j) if i != j else (np.arange(len(arrays)) > x))):
                p, q = top(root[x]), top(root[y])
                if p != q:
                    met[p] = q
                    out.append((min(nodes[x], nodes[y]), max(nodes[x], nodes[y]), common[y], either[y]))
        return pd.DataFrame(out, columns=["a", "b", "common", "either"])

    return each.groupBy("g", "i", "j").applyInPandas(links, "a long, b long, common long, either long")


def _groups(docs: DataFrame, id_col: str, text_col: str, percent: int = PERCENT, small: int = SMALL_BUCKET) -> DataFrame:
    """What near_groups gives, with ``digest``, the name of the shingle set, and ``first``, whether it is the one set that stays of its component."""
    sig = cut_lineage(signatures(docs, id_col, text_col))
    nodes = sig.filter("node is not null").groupBy(F.col("node").alias("digest")).agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").cast("int").alias("n"), F.first("bands").alias("bands"))
    nodes = cut_lineage(nodes.withColumn("node", F.monotonically_increasing_id()))
    sig = sig.select("doc_id", "n_shingles", F.col("node").alias("digest"))
    rows = nodes.select(F.explode("bands").alias("key"), "node", "n")
    bucket = Window.partitionBy("key")
    rows = cut_lineage(rows.withColumn("first", F.min(F.struct("node", "n")).over(bucket)).withColumn("size", F.count("*").over(bucket)).filter("size > 1")
                       .select("key", "node", "n", F.col("first.node").alias("c"), F.least(F.col("first.n") / F.col("n"), F.col("n") / F.col("first.n")).alias("ratio")))
    star = rows.filter(f"c <> node AND 100 * ratio >= {percent}").select(F.col("c").alias("a"), F.col("node").alias("b")).distinct()
    reps = cut_lineage(nodes.select("node", "digest", "rep").join(rows.select("node").distinct(), "node", "left_semi"))
    sets = cut_lineage(_sets(docs, reps, id_col, text_col))
    known = cut_lineage(_verify(star, sets))
    root = cut_lineage(components(_linked(known, percent)))
    # distance to the centre: as counted, or at least what the sizes alone say
    tagged = (rows.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
              .join(root.select(F.col("node").alias("c"), F.col("root").alias("c_root")), "c", "left").withColumn("c_root", F.coalesce("c_root", "c"))
              .join(known.select(F.col("a").alias("c"), F.col("b").alias("node"), (1 - F.col("common") / F.col("either")).alias("d")), ["c", "node"], "left")
              .withColumn("d", F.when(F.col("c") == F.col("node"), F.lit(0.0)).otherwise(F.coalesce("d", 1 - F.col("ratio")))))
    tagged = cut_lineage(tagged.select("key", "node", "n", "root", "d", (F.col("root") != F.col("c_root")).alias("away")))
    mixed = tagged.groupBy("key").agg(F.min(F.when(F.col("away"), F.col("d"))).alias("out")).filter("out is not null")
    # a node of the centre's component reaches a node outside it only if its own distance comes within the bound of theirs
    near = F.col("away") | (F.col("d") >= F.col("out") - (1 - percent / 100) - 1e-9)
    left = cut_lineage(tagged.join(cut_lineage(mixed), "key").filter(near).select("key", "node", "n", "root"))
    count = cut_lineage(left.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key", "size"))
    few = left.join(count.filter(F.col("size") <= small).select("key"), "key", "left_semi")
    x = few.select("key", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"))
    y = few.select("key", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"))
    pairs = (x.join(y, "key").filter(f"a < b AND ra <> rb AND 100 * least(na, nb) >= {percent} * greatest(na, nb)")
             .select("a", "b").distinct().join(known, ["a", "b"], "left_anti"))
    known = known.unionByName(_verify(pairs, sets))
    large = count.filter(F.col("size") > small)
    if has_rows(large):
        known = known.unionByName(_block_links(left.join(large.select("key"), "key", "left_semi"), sets, percent))
    known = cut_lineage(_linked(known, percent).withColumn("common", F.lit(1)).withColumn("either", F.lit(1)))
    root = components(_linked(known, percent))
    classes = nodes.select("node", "digest", "rep").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = classes.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", F.col("digest").alias("set"))).alias("least"))
    label = cut_lineage(classes.join(least, "root").select("digest", F.col("least.rep").alias("component_id"), (F.col("digest") == F.col("least.set")).alias("first")))
    out = sig.join(label, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "digest",
                     F.coalesce("first", F.lit(True)).alias("first"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, small: int = SMALL_BUCKET) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when their sets of distinct five-word shingles share at least ``percent`` of their union; the
    component's smallest id stays. A document without words is linked with nothing and its own component. Repeated rows are
    one node; with the same id all of them count as kept. Null ids lose against any other id; a group of null ids only has
    a null component. Extra columns are not read; an empty table gives no rows. A pair at exactly 75 % misses all common
    buckets with a probability of 5e-6; shingles are compared by 64-bit hashes.
    """
    return _groups(docs, id_col, text_col, percent, small).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of every component, all columns unchanged.

    It is a row with the component's smallest id, also where that is null; of several texts with that id the first by shingle
    set, of rows with the same words the first in hash order. Documents without words all stay, equal rows of them once. Rows
    are joined by their id only where it occurs once, by id and shingle set where it repeats; ids that neither repeat nor are
    dropped pass where they are read.
    """
    groups = cut_lineage(_groups(docs, id_col, text_col, **how).select("doc_id", "digest", (F.col("kept") & F.col("first")).alias("stays")))
    some = cut_lineage(groups.groupBy("doc_id").agg(F.count("*").alias("_n"), F.min("stays").alias("_stays")).filter("_n > 1 OR NOT _stays")
                       .select(F.col("doc_id").alias("_id"), "_n"))
    many = some.filter("_n > 1")
    stay = (flag_ids(groups, id_filter(many, F.col("_id")), F.col("doc_id")).filter("_maybe AND stays")
            .select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct())

    @F.pandas_udf("binary")
    def digest(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            sets = (shingle_set(t, SHINGLE) for t in texts)
            yield pd.Series([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], dtype=object)
        forget_words()

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_key"))
    rows = flag_ids(rows, id_filter(some, F.col("_id")), F.col("_key"))
    # null ids need no look-up: one alone is worked on like repeated ones
    hit = rows.filter("_maybe AND _key IS NOT NULL").join(some, F.col("_key") == F.col("_id"), "left")
    single = hit.filter("_n IS NULL").select("_row.*")
    again = hit.filter("_n > 1").select("_row", "_key").unionByName(rows.filter("_maybe AND _key IS NULL").select("_row", "_key"))
    again = again.withColumn("_set", digest(F.col(f"_row.`{text_col}`")))
    again = again.join(stay, F.col("_key").eqNullSafe(F.col("_id")) & F.col("_set").eqNullSafe(F.col("_digest")), "left_semi")
    blank = again.filter("_set IS NULL").dropDuplicates(["_row"]).select("_row.*")
    first = again.filter("_set IS NOT NULL").groupBy("_key", "_set").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*")
    return rows.filter(~F.col("_maybe")).select("_row.*").unionByName(single).unionByName(blank).unionByName(first)


# Brute force: all pairs that share a shingle, full sets, closure of the links.
SQL = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT r, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE ws[p] || ' ' || ws[p+1] || ' ' || ws[p+2] || ' ' || ws[p+3] || ' ' || ws[p+4] END AS g
      FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM t WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
z AS (SELECT r AS x, r AS y FROM t UNION SELECT z.x, b.y FROM z JOIN b ON b.x = z.y)
SELECT t.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id, t.doc_id IS NOT DISTINCT FROM min(o.doc_id) AS kept
FROM t LEFT JOIN n USING (r) JOIN z ON z.x = t.r JOIN t o ON o.r = z.y GROUP BY t.r, t.doc_id
"""
