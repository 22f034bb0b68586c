"""Table maintenance as pure functions: existing rows and a batch give the new rows.

Every function can be applied again with the same batch without changing its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank
from .topk import first_per_key, previous_value

CHUNK_ROWS = 65_536  # sequence numbers per slice when a long history of one key is compared


def last_of_batch(batch: DataFrame, keys, order) -> DataFrame:
    """One row per key: the last in ``order`` wins."""
    return first_per_key(batch, keys, [F.col(o).desc() if isinstance(o, str) else o for o in order])


def upsert(existing: DataFrame, batch: DataFrame, keys, order=None) -> DataFrame:
    """Insert or overwrite by key; columns the batch does not bring keep their stored value.

    A key counts once per batch: the last row in ``order`` wins, without an order the one with the greatest hash.
    """
    keys = list(keys)
    given = [c for c in batch.columns if c not in keys]
    batch = last_of_batch(batch, keys, order or [F.xxhash64(*[F.col(c) for c in batch.columns]).desc()])
    e = existing.select(*keys, F.struct(*[c for c in existing.columns if c not in keys]).alias("_old"), F.lit(True).alias("_in_old"))
    b = batch.select(*keys, F.struct(*given).alias("_new"), F.lit(True).alias("_in_new"))
    out = e.join(b, keys, "full_outer")
    cols = []
    for c in existing.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c in given:
            cols.append(F.when(F.col("_in_new"), F.col("_new")[c]).otherwise(F.col("_old")[c]).alias(c))
        else:
            cols.append(F.col("_old")[c].alias(c))
    return out.select(*cols)


def classify_batch(existing: DataFrame, batch: DataFrame, keys) -> DataFrame:
    """The batch with ``is_new``: whether its key was not stored before."""
    known = existing.select(*keys).distinct().withColumn("_known", F.lit(True))
    return batch.join(known, list(keys), "left").withColumn("is_new", F.col("_known").isNull()).drop("_known")


def upsert_classified(existing: DataFrame, batch: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """New table and the classified batch; rows missing from the batch stay."""
    return upsert(existing, batch, keys), classify_batch(existing, batch, keys)


def upsert_hints(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Feed hints by (source, id); absent ones are never removed."""
    return upsert(existing, batch, ["source_id", "id"])


def replace_children(children: DataFrame, batch: DataFrame, parent: str, touched: DataFrame) -> DataFrame:
    """All children of the touched parents are replaced by the batch; ``touched`` holds the parent ids."""
    ids = touched.select(parent).distinct()
    return children.join(ids, parent, "left_anti").select(*children.columns).unionByName(batch)


def content_hash(df: DataFrame, cols, name: str = "content_hash") -> DataFrame:
    """SHA-256 of the columns as JSON in key order."""
    state = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(cols)])
    return df.withColumn(name, F.sha2(F.to_json(state), 256))


def changed_only(observations: DataFrame, key, seq: str, chunk: Column, hash_col: str = "content_hash") -> DataFrame:
    """Observations whose content differs from the one before; A, B, A gives three rows."""
    df = previous_value(observations, key, seq, chunk, hash_col, "prev_hash")
    return df.filter(~F.col("has_prev_hash") | (F.col(hash_col) != F.col("prev_hash"))).drop("prev_hash", "has_prev_hash")


def append_changed_snapshots(history: DataFrame, batch: DataFrame, key: str = "id", seq: str = "seq",
                             chunk: Column | None = None) -> DataFrame:
    """Rows of the batch to append: changed within the batch and against the last stored snapshot."""
    chunk = chunk if chunk is not None else F.floor(F.col(seq) / CHUNK_ROWS)
    last = history.groupBy(key).agg(F.max_by("content_hash", seq).alias("_last"), F.max(seq).alias("_last_seq"))
    df = previous_value(batch, [key], seq, chunk, "content_hash", "prev_hash").join(last, key, "left")
    before = F.when(F.col("has_prev_hash"), F.col("prev_hash")).otherwise(F.col("_last"))
    fresh = F.col("_last_seq").isNull() | (F.col(seq) > F.col("_last_seq"))
    return df.filter(fresh & (before.isNull() | (before != F.col("content_hash")))).select(*batch.columns)


def close_list(procedures: DataFrame, runs: DataFrame) -> DataFrame:
    """After a complete list, procedures of its source not seen in that run are no longer listed.

    ``runs`` has source_id, run_id, complete; procedures are never deleted and partial runs change nothing.
    """
    done = runs.filter("complete").groupBy("source_id").agg(F.max("run_id").alias("_run"))
    closed = F.col("_run").isNotNull() & (F.col("run_id") != F.col("_run"))
    return procedures.join(done, "source_id", "left").withColumn("listed", F.col("listed") & ~closed).select(*procedures.columns)


def replace_documents_if_ok(documents: DataFrame, batch: DataFrame, details: DataFrame) -> DataFrame:
    """Documents of a record are replaced only where its detail page was read; details: record_id, status."""
    ok = details.filter("status = 'ok'").select("record_id").distinct()
    kept = documents.join(ok, "record_id", "left_anti").select(*documents.columns)
    return kept.unionByName(batch.join(ok, "record_id", "left_semi"))


def set_detail_status(plans: DataFrame, details: DataFrame) -> DataFrame:
    new = details.groupBy(F.col("record_id").alias("id")).agg(F.max("status").alias("_st"))
    return plans.join(new, "id", "left").withColumn("detail_status", F.coalesce("_st", "detail_status")).select(*plans.columns)


def flag_deleted(table: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Soft deletion of the rows whose ``column`` is listed in ``ids`` (one column)."""
    gone = ids.select(F.col(ids.columns[0]).alias(column)).distinct().withColumn("_gone", F.lit(True))
    return (table.join(gone, column, "left").withColumn("deleted", F.coalesce("_gone", "deleted", F.lit(False)))
            .drop("_gone").select(*table.columns))


def soft_delete(tables: dict[str, DataFrame], kind: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Flag objects and their children; a deleted paper also loses its places."""
    out = dict(tables)
    if kind == "committee":
        out["committees"] = flag_deleted(tables["committees"], ids, "id")
    elif kind == "meeting":
        out["meetings"] = flag_deleted(tables["meetings"], ids, "id")
        out["agenda_items"] = flag_deleted(tables["agenda_items"], ids, "meeting_id")
        out["documents"] = flag_deleted(tables["documents"], ids, "meeting_id")
    elif kind == "record":
        out["records"] = flag_deleted(tables["records"], ids, "id")
        out["consultations"] = flag_deleted(tables["consultations"], ids, "record_id")
        out["documents"] = flag_deleted(tables["documents"], ids, "record_id")
        out["places"] = tables["places"].join(ids.select(F.col(ids.columns[0]).alias("id")), "id", "left_anti").select(*tables["places"].columns)
    else:
        raise ValueError(f"unknown kind of object: {kind}")
    return out


def real_over_sample(existing: DataFrame, batch: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of the batch that may be written: sample rows never replace real ones."""
    sample = sources.select(F.col("id").alias("source_id"), F.coalesce("sample", F.lit(False)).alias("_sample"))
    real = existing.join(sample, "source_id").filter(~F.col("_sample")).select("id").distinct().withColumn("_real", F.lit(True))
    df = batch.join(sample, "source_id", "left").join(real, "id", "left")
    return df.filter(~F.coalesce("_sample", F.lit(False)) | F.col("_real").isNull()).select(*batch.columns)


def first_real_loads(existing: DataFrame, batch: DataFrame, sources: DataFrame) -> DataFrame:
    """Ids whose stored row is a sample and whose batch row is another source: their sample history goes."""
    sample = sources.filter(F.coalesce("sample", F.lit(False))).select(F.col("id").alias("source_id"))
    old = existing.join(sample, "source_id", "left_semi").select("id", F.col("source_id").alias("_old"))
    return batch.join(old, "id").filter(F.col("source_id") != F.col("_old")).select("id").distinct()


def replace_places(places: DataFrame, new: DataFrame, touched: DataFrame, provenances) -> DataFrame:
    """Rows of the touched records with these provenances are replaced, all others stay."""
    mine = F.col("provenance").isin(*provenances)
    kept = places.filter(~mine).unionByName(places.filter(mine).join(touched.select("id").distinct(), "id", "left_anti").select(*places.columns))
    return kept.unionByName(new.select(*places.columns)).distinct()


def place_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Difference of two sets of places: change is 'added' or 'removed'."""
    cols = ["id", "type", "key", "provenance"]
    both = old.select(*cols, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(*cols, F.lit(0).alias("o"), F.lit(1).alias("n")))
    agg = both.groupBy(*cols).agg(F.max("o").alias("o"), F.max("n").alias("n"))
    return agg.filter("o <> n").select(*cols, F.when(F.col("n") == 1, "added").otherwise("removed").alias("change"))


# Columns by which the tables hang on the records and meetings of a source.
OWNED_BY = {
    "consultations": (("record_id", "records"),), "documents": (("record_id", "records"), ("meeting_id", "meetings")),
    "agenda_items": (("meeting_id", "meetings"),), "relations": (("from_id", "records"), ("to_id", "records")),
    "places": (("id", "records"),), "plans": (("id", "records"),), "snapshots": (("id", "records"),), "entries": (("id", "records"),),
}


def purge_source(tables: dict[str, DataFrame], source: str) -> dict[str, DataFrame]:
    """Remove everything of one source, including relations that point at its records."""
    mine = F.col("source_id") == source
    gone = {n: tables[n].filter(mine).select("id") for n in ("records", "meetings") if n in tables}
    out = {}
    for name, df in tables.items():
        if "source_id" in df.columns:
            df = df.filter(~mine)
        for col, owner in OWNED_BY.get(name, ()):
            if owner in gone:
                df = df.join(gone[owner].withColumnRenamed("id", col), col, "left_anti")
        out[name] = df.select(*tables[name].columns)
    return out


def dedupe_entries(entries: DataFrame, page: str = "page_id", pos: str = "pos") -> DataFrame:
    """The first entry per id inside one page."""
    return first_per_key(entries, [page, "id"], [F.col(pos)])


def changed_since(objects: DataFrame, bounds: DataFrame) -> DataFrame:
    """Objects modified at or after the bound of their (source, entity); without a bound all of them."""
    b = bounds.select("source_id", "entity", F.col("modified_since").alias("_since"))
    return (objects.join(b, ["source_id", "entity"], "left").select(*objects.columns, "_since")
            .filter(F.col("_since").isNull() | (blank("_since") == "") | (F.col("modified").cast("timestamp") >= F.col("_since").cast("timestamp")))
            .drop("_since"))


def next_bounds(bounds: DataFrame, series: DataFrame) -> DataFrame:
    """Bounds after a load: a complete series starts one hour before its begin, an open one keeps its bound.

    ``series`` has source_id, entity, started, complete, next_url, updated.
    """
    start = F.date_format(F.col("started").cast("timestamp") - F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    old = bounds.select("source_id", "entity", F.col("modified_since").alias("_old"))
    done = F.col("complete")
    fresh = series.join(old, ["source_id", "entity"], "left").select(
        "source_id", "entity", F.when(done, start).otherwise(blank("_old")).alias("modified_since"),
        F.when(done, "").otherwise(blank("next_url")).alias("next_url"),
        F.when(done, "").otherwise(blank("started")).alias("series_start"), "updated")
    return upsert(bounds, fresh, ["source_id", "entity"])


def pending_details(queue: DataFrame, done: DataFrame) -> DataFrame:
    """Detail pages still to read."""
    return queue.join(done.select("source_id", "record_id").distinct(), ["source_id", "record_id"], "left_anti")


def pending_counts(queue: DataFrame, done: DataFrame) -> DataFrame:
    return pending_details(queue, done).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_open"))


def source_states(sources: DataFrame, attempts: DataFrame) -> DataFrame:
    """Sources after their attempts (source_id, at, status, error, pause_until): samples last, then id."""
    agg = attempts.groupBy(F.col("source_id").alias("id")).agg(
        F.max_by(F.struct("status", blank("error").alias("error"), blank("pause_until").alias("pause_until")), F.col("at")).alias("_l"),
        F.max("at").alias("_try"), F.max(F.when(F.col("status") == "ok", F.col("at"))).alias("_ok"))
    return (sources.join(agg, "id", "left")
            .withColumn("status", F.coalesce("_l.status", "status")).withColumn("error", F.coalesce("_l.error", "error"))
            .withColumn("pause_until", F.coalesce("_l.pause_until", "pause_until"))
            .withColumn("last_try", F.coalesce("_try", "last_try")).withColumn("last_success", F.coalesce("_ok", "last_success"))
            .select(*sources.columns))
