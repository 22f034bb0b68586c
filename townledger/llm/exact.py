"""Exact duplicates by composable polynomial fingerprints, confirmed chunk by chunk.

A text is read as a number in base 256 and reduced by a prime; the fingerprint of a chunk sequence follows from those of the
chunks, shifted by the lengths that follow. Chunks of one document are rows, so a huge document is hashed by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, flag_ids, has_rows, id_filter, lower_ascii

CHUNK = 65536
# A prime of 122 bits without special form, so that powers of 256 do not fall into a short cycle.
PRIME = (1 << 121) + 0x1F2E3D4C5B6A79881726354453627103
MEMBERS_PER_TASK = 256


def _is_prime(n: int) -> bool:
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


while not _is_prime(PRIME):
    PRIME += 2 if PRIME % 2 else 1


def chunk_hash(data: bytes, prime: int = PRIME) -> int:
    return int.from_bytes(data, "big") % prime


def combine(left: int, right: int, right_length: int, prime: int = PRIME) -> int:
    """Fingerprint of left + right from both fingerprints and the length of the right one."""
    return (left * pow(256, right_length, prime) + right) % prime


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, prime: int = PRIME) -> DataFrame:
    """(doc_id, n_bytes, sha, fp, copies): one row per id and normalised text; equal rows are counted in ``copies``."""
    @F.pandas_udf("binary")
    def hash_chunks(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([chunk_hash(bytes(b), prime).to_bytes(16, "big") for b in s], dtype=object)

    @F.pandas_udf("binary")
    def join_chunks(parts: pd.Series, n_bytes: pd.Series) -> pd.Series:
        out = []
        for hashes, n in zip(parts, n_bytes):
            total = 0
            for x in sorted(hashes, key=lambda h: h["pos"]):
                total = combine(total, int.from_bytes(x["h"], "big"), min(chunk, n - x["pos"] * chunk), prime)
            out.append(total.to_bytes(16, "big"))
        return pd.Series(out, dtype=object)

    pieces = F.expr(f"transform(sequence(0, cast(greatest(n_bytes - 1, 0) div {chunk} as int)), k -> substring(b, k * {chunk} + 1, {chunk}))")
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.encode(lower_ascii(F.col(text_col)), "UTF-8").alias("b"))
            .select("doc_id", "b", F.octet_length("b").cast("long").alias("n_bytes"), F.sha2("b", 256).alias("sha"))
            .select("doc_id", "n_bytes", "sha", F.posexplode(pieces).alias("pos", "piece"))
            .select("doc_id", "n_bytes", "sha", "pos", hash_chunks("piece").alias("h")))
    return (rows.groupBy("doc_id", "n_bytes", "sha")
            .agg(F.collect_set(F.struct("pos", "h")).alias("parts"), F.sum((F.col("pos") == 0).cast("long")).alias("copies"))
            .select("doc_id", "n_bytes", "sha", join_chunks("parts", "n_bytes").alias("fp"), "copies"))


def _verify(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, chunk: int) -> DataFrame:
    """Members (doc_id, sha, fp, n_bytes, keep_id, keep_sha, m) whose text is not that of the one that stays.

    Only texts that may belong to a group are shuffled. The text that stays is sent once for every ``MEMBERS_PER_TASK``
    members, so no task gets a whole large group, and texts are compared chunk by chunk.
    """
    null_safe = F.col("doc_id").eqNullSafe(F.col("id"))
    texts = flag_ids(docs.select(F.col(id_col).alias("id"), F.encode(lower_ascii(F.col(text_col)), "UTF-8").alias("b")),
                     id_filter(members, F.col("doc_id")), F.col("id")).filter("_maybe").select("id", "b", F.sha2("b", 256).alias("s"))
    texts = texts.join(members, null_safe & (F.col("s") == F.col("sha")))
    pieces = F.expr(f"transform(sequence(0, cast(greatest(n_bytes - 1, 0) div {chunk} as int)), k -> substring(b, k * {chunk} + 1, {chunk}))")
    parts = texts.select("doc_id", "sha", "fp", "n_bytes", "keep_id", "keep_sha", "m", F.posexplode(pieces).alias("pos", "piece"))
    salts = F.expr(f"cast(m div {MEMBERS_PER_TASK} as int)")
    mine = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "sha"), salts + 1).cast("int"))
    first = (parts.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha")))
             .dropDuplicates(["fp", "n_bytes", "pos"])
             .select(F.col("fp").alias("f"), F.col("n_bytes").alias("nb"), F.col("pos").alias("p"), F.col("piece").alias("first"),
                     F.explode(F.sequence(F.lit(0), salts)).alias("t")))
    joined = mine.join(first, (F.col("fp") == F.col("f")) & (F.col("n_bytes") == F.col("nb")) & (F.col("pos") == F.col("p")) & (F.col("salt") == F.col("t")), "left")
    return joined.filter(F.col("first").isNull() | (F.col("piece") != F.col("first"))).select("doc_id", "sha").distinct()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, prime: int = PRIME) -> DataFrame:
    """(doc_id, sha, copies, keep_id, keep_sha, group_size): one row per id and normalised text.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest id of a group stays, a null id
    only if the group has no other. Texts with equal fingerprints but different bytes are told apart by the comparison and
    grouped anew among themselves, until none is left.
    """
    pending, done = cut_lineage(fingerprints(docs, id_col, text_col, chunk, prime)), None
    while True:
        groups = cut_lineage(pending.groupBy("fp", "n_bytes").agg(
            F.max(F.struct("doc_id", "sha")).alias("top"), F.sum("copies").alias("group_size"), F.count("*").alias("m"))
            .select("fp", "n_bytes", F.col("top.doc_id").alias("keep_id"), F.col("top.sha").alias("keep_sha"), "group_size", "m"))
        joined = pending.join(groups, ["fp", "n_bytes"])
        members = cut_lineage(joined.filter("m > 1"))
        differ = cut_lineage(_verify(docs, members, id_col, text_col, chunk))
        found = has_rows(differ)
        if not found:
            part = joined
        else:  # different texts under one fingerprint
            other = F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("sha") == F.col("d_sha"))
            off = differ.select(F.col("doc_id").alias("d_id"), F.col("sha").alias("d_sha"))
            right = cut_lineage(joined.drop("group_size").join(off, other, "left_anti"))
            sizes = right.groupBy("fp", "n_bytes").agg(F.sum("copies").alias("group_size"))
            part = right.join(sizes, ["fp", "n_bytes"])
            pending = cut_lineage(pending.join(off, other, "left_semi"))
        part = part.select("doc_id", "sha", "copies", "keep_id", "keep_sha", "group_size")
        done = part if done is None else done.unionByName(part)
        if not found:
            return done


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of repeated rows with the same id and text the first counts as kept, the others as dropped copies. Null and empty texts
    are one group. Null ids lose against any other id. Extra columns are not read; an empty table gives no rows.
    """
    g = exact_groups(docs, id_col, text_col, **how).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha")) & (F.col("copy") == 1)
    return g.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged.

    Only rows whose id occurs in a group of several are joined; all others pass where they are read.
    """
    groups = cut_lineage(exact_groups(docs, id_col, text_col, **how).filter("group_size > 1").select(
        F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha"))).alias("_first")))
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("_row"), F.col(f"`{id_col}`").alias("_key"), F.col(f"`{text_col}`").alias("_text"))
    rows = flag_ids(rows, id_filter(groups, F.col("_id")), F.col("_key"))
    hit = rows.filter("_maybe").withColumn("_s", F.sha2(F.encode(lower_ascii(F.col("_text")), "UTF-8"), 256)).drop("_text")
    hit = hit.join(groups, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_s") == F.col("_sha")), "left").filter(F.coalesce("_first", F.lit(True)))
    single = hit.filter("_first IS NULL").select("_row.*")
    first = hit.filter("_first").groupBy("_id", "_sha").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*")
    return rows.filter(~F.col("_maybe")).select("_row.*").unionByName(single).unionByName(first)


SQL = r"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       row_number() OVER (PARTITION BY x ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(x) AS text_sha256 FROM t
"""
