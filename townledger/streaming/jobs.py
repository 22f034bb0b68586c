"""The incremental loads as Structured Streaming jobs.

State that must outlive a batch lies in Spark's state store, partitioned by key and restored from the checkpoint; results are
appended (see ``deltas``). Repeated or overlapping deliveries change nothing, and no late object is ever dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import places as P
from ..operators import reports as R
from ..operators.dims import CityDims
from .deltas import current, deltas, write_delta


def _appended(stream: DataFrame, path: str, checkpoint: str, mode: str = "update"):
    """Start the stream over everything that has arrived; what changes is appended. The caller awaits or schedules it."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        write_delta(batch, path, batch_id)

    return (stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_upsert(stream: DataFrame, path: str, keys, order, checkpoint: str):
    """The row of each key that is last in ``order``; ``current_rows`` reads the table.

    The state holds that row per key, so an overlapping older delivery does not win; of rows equal in ``order`` the one with the
    greatest hash does. A batch gives out the keys it changed.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in stream.columns if c not in keys]
    place = F.struct(*order, F.xxhash64(*stream.columns).alias("_hash"))
    last = stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), place).alias("_row")).select(*keys, "_row.*")
    return _appended(last, path, checkpoint)


def current_rows(spark: SparkSession, path: str, keys) -> DataFrame:
    return current(deltas(spark, path), list(keys))


def stream_changes(stream: DataFrame, history: str, checkpoint: str, key: str = "id", seq: str = "seq"):
    """Append a snapshot only where the content differs from the one before it.

    The state holds the last sequence number and hash per key. A snapshot that does not come after the last one was there before.
    Rows of a key arrive in pieces; only number, hash and place of a batch's rows are sorted.
    """
    def changed(found: tuple, pieces: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last_seq, last_hash = state.get if state.exists else (None, None)
        rows = pd.concat(list(pieces), ignore_index=True).drop_duplicates(seq).sort_values(seq)
        if last_seq is not None:
            rows = rows[rows[seq] > last_seq]
        if len(rows):
            before = rows["content_hash"].shift(1)
            before.iloc[0] = last_hash
            state.update((int(rows[seq].iloc[-1]), rows["content_hash"].iloc[-1]))
            yield rows[(rows["content_hash"] != before).to_numpy()]

    shape = StructType(stream.schema.fields)
    return _appended(stream.groupBy(key).applyInPandasWithState(changed, shape, "seq long, content_hash string", "append", "NoTimeout"), history, checkpoint, "append")


def stream_closure(stream: DataFrame, path: str, checkpoint: str):
    """List entries and end markers of runs: unseen entries are unlisted once their run is complete, see ``listed_state``.

    Rows are source_id, id, run_id, marker; a marker row (marker true) says the run's list was read
    to its end. Runs are ordered by run_id. Partial and late runs change nothing.
    """
    item = F.when(~F.col("marker"), F.col("id")).alias("id")
    newest = stream.groupBy("source_id", item, "marker").agg(F.max("run_id").alias("run_id"))
    return _appended(newest, path, checkpoint)


def listed_state(rows: DataFrame) -> DataFrame:
    """What is listed: seen in the last complete run of the source or in a run after it."""
    newest = rows.groupBy("source_id", "id", "marker").agg(F.max("run_id").alias("run_id"))
    done = newest.filter("marker").groupBy("source_id").agg(F.max("run_id").alias("_done"))
    return (newest.filter("NOT marker").drop("marker").join(done, "source_id", "left")
            .withColumn("listed", F.col("_done").isNull() | (F.col("run_id") >= F.col("_done"))).drop("_done"))


def stream_demand(stream: DataFrame, path: str, checkpoint: str):
    """Demand of (city, span of days): the state holds the distinct seconds of one span, so a busy city is bounded by time.

    A batch gives out the cases of the spans it has rows of; ``demand_state`` strings the newest ones together. Spans are small as
    a rule: a task works them out from rows that hold a whole span each, not by a call of its own per span.
    """
    s = F.unix_timestamp("at")
    spans = stream.select("city", F.floor(s / R.SPAN_S).cast("long").alias("span"), s.alias("s")).groupBy("city", "span").agg(F.collect_set("s").alias("seconds"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_delta(R.cases_of_spans(batch), path, batch_id)

    return spans.writeStream.foreachBatch(handle).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def demand_state(spark: SparkSession, path: str, now=None, days: int | None = None) -> DataFrame:
    """Demand noted so far; with ``now`` and ``days`` only what still holds."""
    rows = deltas(spark, path)
    newest = rows.groupBy("city", "span").agg(F.max("batch").alias("batch"))
    out = R.walk_spans(rows.join(newest, ["city", "span", "batch"]))
    if now is None or days is None:
        return out
    return out.filter(F.col("last_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


PLACE_LIST = "array<struct<type:string,key:string,provenance:string>>"


def stream_annotate(stream: DataFrame, dims: CityDims, path: str, checkpoint: str, *parts: tuple):
    """Places of each arriving record (city, id and text columns) as one row; ``annotated`` reads those of its newest batch."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        found = P.match_places(P.texts_of(batch, *parts), dims).groupBy("id").agg(F.collect_set(F.struct("type", "key", "provenance")).alias("places"))
        rows = batch.select("id").distinct().join(found, "id", "left").withColumn("places", F.coalesce("places", F.array().cast(PLACE_LIST)))
        write_delta(rows, path, batch_id)

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def annotated(spark: SparkSession, path: str) -> DataFrame:
    """id, type, key, provenance of every record as found in its newest delivery."""
    return current(deltas(spark, path), ["id"]).select("id", F.explode("places").alias("p")).select("id", "p.*")
