"""Table maintenance: orders as stored rows, other columns of the same tables as the batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from townledger.operators import tables as T

from .base import query


def stored(t):
    return t("orders").filter("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("s"), F.col("o_custkey") % 5).alias("source_id"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("kind"))


def batch(t):
    return t("orders").filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("s"), F.col("o_custkey") % 5).alias("source_id"), F.lower("o_orderpriority").alias("kind"))


@query("upsert", """SELECT o_orderkey AS id, 's' || o_custkey % 5 AS source_id, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderstatus END AS state, CASE WHEN o_orderkey % 4 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS kind FROM orders WHERE o_orderkey % 10 <> 0 OR o_orderkey % 4 = 0""")
def upsert(t):
    return T.upsert(stored(t), batch(t), ["id"])


@query("upsert_classified", "SELECT o_orderkey % 10 = 0 AS is_new, count(*) AS n FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1")
def upsert_classified(t):
    return T.upsert_classified(stored(t), batch(t), ["id"])[1].groupBy("is_new").agg(F.count(F.lit(1)).alias("n"))


@query("upsert_hints", """SELECT CAST(user_id AS VARCHAR) AS source_id, k AS id, CASE WHEN b IS NOT NULL THEN b ELSE a END AS title FROM (SELECT user_id, event_id % 100 AS k, min(CASE WHEN event_type <> 'view' THEN event_type END) AS a, max(CASE WHEN event_type <> 'click' THEN event_type END) AS b FROM events GROUP BY 1, 2)""")
def upsert_hints(t):
    e = t("events").select(F.col("user_id").cast("string").alias("source_id"), (F.col("event_id") % 100).alias("id"), "event_type")
    old = e.filter("event_type <> 'view'").groupBy("source_id", "id").agg(F.min("event_type").alias("title"))
    new = e.filter("event_type <> 'click'").groupBy("source_id", "id").agg(F.max("event_type").alias("title"))
    return T.upsert_hints(old, new)


@query("last_of_batch", "SELECT l_orderkey, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey")
def last_of_batch(t):
    return T.last_of_batch(t("lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], ["l_linenumber"])


@query("replace_children", "SELECT l_orderkey AS record_id, l_linenumber AS no, count(*) AS n FROM lineitem WHERE l_orderkey % 3 <> 0 OR l_linenumber <= 2 GROUP BY 1, 2")
def replace_children(t):
    li = t("lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("no"))
    touched = t("lineitem").filter("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("record_id"))
    new = li.filter("record_id % 3 = 0 and no <= 2")
    return T.replace_children(li, new, "record_id", touched).groupBy("record_id", "no").agg(F.count(F.lit(1)).alias("n"))


def observations(t):
    e = t("events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type", (F.col("value") > 50).alias("big"), "ts")
    return T.content_hash(e, ["event_type", "big"])


CHANGED = "SELECT id, seq FROM (SELECT user_id AS id, event_id AS seq, event_type, value > 50 AS big, lag(event_type) OVER w AS p, lag(value > 50) OVER w AS pb FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE (p IS NULL OR p <> event_type OR pb <> big)"


@query("changed_snapshots", CHANGED)
def changed_snapshots(t):
    return T.changed_only(observations(t), ["id"], "seq", F.to_date("ts")).select("id", "seq")


@query("append_snapshots", CHANGED + " AND seq > (SELECT max(event_id) // 2 FROM events)")
def append_snapshots(t):
    """History up to the middle of the log, then everything delivered again."""
    obs = observations(t)
    half = t("events").agg(F.floor(F.max("event_id") / 2).alias("h")).scalar()
    history = T.changed_only(obs.filter(F.col("seq") <= half), ["id"], "seq", F.to_date("ts"))
    late = obs.filter(F.col("seq") > half)
    return T.append_changed_snapshots(history, late, chunk=F.to_date("ts")).select("id", "seq")


@query("content_hashes", """SELECT user_id, event_id, sha256('{"big":"' || CASE WHEN value > 50 THEN 'true' ELSE 'false' END || '","event_type":"' || event_type || '"}') AS h FROM events""")
def content_hashes(t):
    return observations(t).select(F.col("id").alias("user_id"), F.col("seq").alias("event_id"), F.col("content_hash").alias("h"))


@query("close_list", "SELECT o_orderkey AS id, NOT (o_custkey % 5 IN (0, 2) AND o_orderstatus <> 'O') AS listed FROM orders")
def close_list(t):
    """Two of five sources have a complete run; its id is 'O'."""
    p = t("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("s"), F.col("o_custkey") % 5).alias("source_id"), F.col("o_orderstatus").alias("run_id"), F.lit(True).alias("listed"))
    runs = t("orders").select(F.concat(F.lit("s"), F.col("o_custkey") % 5).alias("source_id")).distinct().select("source_id", F.lit("O").alias("run_id"), F.col("source_id").isin("s0", "s2").alias("complete"))
    return T.close_list(p, runs).select("id", "listed")


@query("documents_if_ok", "SELECT o_orderkey AS record_id, CASE WHEN o_orderstatus = 'O' THEN 'neu' ELSE 'alt' END AS name FROM orders")
def documents_if_ok(t):
    o = t("orders").select(F.col("o_orderkey").alias("record_id"))
    details = t("orders").select(F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "P", "login").otherwise("unknown").alias("status"))
    return T.replace_documents_if_ok(o.withColumn("name", F.lit("alt")), o.withColumn("name", F.lit("neu")), details)


def _all(t):
    o, li = t("orders"), t("lineitem")
    k = F.col("o_orderkey")
    return {
        "records": o.select(k.alias("id"), F.concat(F.lit("s"), F.col("o_custkey") % 5).alias("source_id"), F.lit(False).alias("deleted")),
        "consultations": li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("record_id"), F.lit(False).alias("deleted")),
        "documents": o.select(F.concat(F.lit("d"), k).alias("id"), k.alias("record_id"), F.col("o_custkey").alias("meeting_id"), F.lit(False).alias("deleted")),
        "places": o.select(k.alias("id"), F.lit("plz").alias("type"), F.col("o_orderpriority").alias("key"), F.lit("betreff").alias("provenance")),
        "meetings": t("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("s"), F.col("c_nationkey") % 5).alias("source_id"), F.lit(False).alias("deleted")),
        "agenda_items": li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_suppkey").alias("meeting_id"), F.lit(False).alias("deleted")),
        "relations": li.select(F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.col("l_returnflag").alias("kind")).distinct()}


def _counts(tables):
    out = None
    for name, df in tables.items():
        gone = F.count_if("deleted") if "deleted" in df.columns else F.lit(0).cast("long")
        row = df.agg(F.count(F.lit(1)).alias("n"), gone.alias("gone")).withColumn("table_name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("soft_delete", """SELECT 'records' AS table_name, count(*) AS n, count(*) FILTER (o_orderkey % 6 = 0) AS gone FROM orders UNION ALL SELECT 'consultations', count(*), count(*) FILTER (l_orderkey % 6 = 0) FROM lineitem
  UNION ALL SELECT 'documents', count(*), count(*) FILTER (o_orderkey % 6 = 0 OR o_custkey % 8 = 0) FROM orders UNION ALL SELECT 'places', count(*) FILTER (o_orderkey % 6 <> 0), 0 FROM orders
  UNION ALL SELECT 'meetings', count(*), count(*) FILTER (c_custkey % 8 = 0) FROM customer UNION ALL SELECT 'agenda_items', count(*), count(*) FILTER (l_suppkey % 8 = 0) FROM lineitem""".replace("UNION ALL SELECT 'agenda_items', count(*), count(*) FILTER (l_suppkey % 8 = 0) FROM lineitem",
       "UNION ALL SELECT 'agenda_items', count(*), count(*) FILTER (l_suppkey % 8 = 0 AND l_suppkey IN (SELECT c_custkey FROM customer)) FROM lineitem"))
def soft_delete(t):
    tables = _all(t)
    tables = T.soft_delete(tables, "record", t("orders").filter("o_orderkey % 6 = 0").select(F.col("o_orderkey").alias("id")))
    tables = T.soft_delete(tables, "meeting", t("customer").filter("c_custkey % 8 = 0").select(F.col("c_custkey").alias("id")))
    del tables["relations"]
    return _counts(tables)


@query("purge_source", """SELECT 'records' AS table_name, count(*) AS n, CAST(0 AS BIGINT) AS gone FROM orders WHERE o_custkey % 5 <> 2 UNION ALL SELECT 'consultations', count(*), 0 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 5 = 2)
  UNION ALL SELECT 'documents', count(*), 0 FROM orders WHERE o_custkey % 5 <> 2 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey % 5 = 2) UNION ALL SELECT 'places', count(*), 0 FROM orders WHERE o_custkey % 5 <> 2
  UNION ALL SELECT 'meetings', count(*), 0 FROM customer WHERE c_nationkey % 5 <> 2 UNION ALL SELECT 'agenda_items', count(*), 0 FROM lineitem WHERE l_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey % 5 = 2)
  UNION ALL SELECT 'relations', count(*), 0 FROM (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 5 = 2) AND l_partkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 5 = 2)""")
def purge_source(t):
    return _counts(T.purge_source(_all(t), "s2"))


@query("replace_by_provenance", """SELECT id, key, provenance FROM (SELECT o_custkey AS id, o_orderpriority AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'oparl' ELSE 'betreff' END AS provenance FROM orders) WHERE provenance = 'oparl' OR id % 2 = 1
  UNION SELECT o_custkey, o_orderstatus, 'betreff' FROM orders WHERE o_custkey % 2 = 0""")
def replace_by_provenance(t):
    o = t("orders")
    old = o.select(F.col("o_custkey").alias("id"), F.lit("plz").alias("type"), F.col("o_orderpriority").alias("key"), F.when(F.col("o_orderkey") % 3 == 0, "oparl").otherwise("betreff").alias("provenance"))
    new = o.filter("o_custkey % 2 = 0").select(F.col("o_custkey").alias("id"), F.lit("plz").alias("type"), F.col("o_orderstatus").alias("key"), F.lit("betreff").alias("provenance"))
    return T.replace_places(old, new, new.select("id"), ("betreff", "beschreibung", "strasse")).select("id", "key", "provenance")


@query("real_over_sample", """SELECT o_orderkey AS id, 's' || o_orderkey % 5 AS source_id FROM orders WHERE o_orderkey % 5 <> 0 OR NOT (o_orderkey % 10 <> 0 AND o_custkey % 5 <> 0)""")
def real_over_sample(t):
    """Source s0 holds samples."""
    sources = t("orders").select(F.concat(F.lit("s"), F.col("o_custkey") % 5).alias("id")).distinct().withColumn("sample", F.col("id") == "s0")
    b = t("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("s"), F.col("o_orderkey") % 5).alias("source_id"))
    return T.real_over_sample(stored(t), b, sources)


@query("first_real_loads", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 <> 0 AND o_custkey % 5 = 0 AND o_orderkey % 5 <> 0")
def first_real_loads(t):
    sources = t("orders").select(F.concat(F.lit("s"), F.col("o_custkey") % 5).alias("id")).distinct().withColumn("sample", F.col("id") == "s0")
    b = t("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("s"), F.col("o_orderkey") % 5).alias("source_id"))
    return T.first_real_loads(stored(t), b, sources)


@query("dedupe_entries", "SELECT l_suppkey AS page_id, l_partkey AS id, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY 1, 2")
def dedupe_entries(t):
    e = t("lineitem").select(F.col("l_suppkey").alias("page_id"), F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return T.dedupe_entries(e)


@query("changed_since", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderdate >= CASE o_orderstatus WHEN 'O' THEN TIMESTAMP '1999-01-01' ELSE TIMESTAMP '2000-06-01' END")
def changed_since(t):
    o = t("orders").select("o_orderkey", F.lit("s").alias("source_id"), F.col("o_orderstatus").alias("entity"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified"))
    b = t("orders").select(F.lit("s").alias("source_id"), F.col("o_orderstatus").alias("entity")).distinct()
    b = b.withColumn("modified_since", F.when(F.col("entity") == "O", "1999-01-01T00:00:00Z").when(F.col("entity") == "P", "").otherwise("2000-06-01T00:00:00Z"))
    return T.changed_since(o, b).select("o_orderkey")


@query("next_bounds", """SELECT CAST(c_custkey AS VARCHAR) AS source_id, CASE WHEN c_custkey % 3 = 0 THEN '2026-01-01T09:00:00Z' ELSE 'alt' END AS modified_since, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'https://n/' || c_custkey END AS next_url FROM customer""")
def next_bounds(t):
    c = t("customer").select(F.col("c_custkey").cast("string").alias("source_id"), F.lit("vorlagen").alias("entity"))
    b = c.select("*", F.lit("alt").alias("modified_since"), F.lit("").alias("next_url"), F.lit("").alias("series_start"), F.lit("").alias("updated"))
    s = c.select("*", F.lit("2026-01-01T10:00:00Z").alias("started"), (F.col("source_id").cast("int") % 3 == 0).alias("complete"), F.concat(F.lit("https://n/"), "source_id").alias("next_url"), F.lit("u").alias("updated"))
    return T.next_bounds(b, s).select("source_id", "modified_since", "next_url")


@query("pending_details", "SELECT 's' || o_custkey % 5 AS source_id, count(*) AS n_open FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def pending_details(t):
    q = t("orders").select(F.concat(F.lit("s"), F.col("o_custkey") % 5).alias("source_id"), F.col("o_orderkey").alias("record_id"), "o_orderstatus")
    return T.pending_counts(q.drop("o_orderstatus"), q.filter("o_orderstatus = 'F'"))


@query("source_states", """SELECT CAST(user_id AS VARCHAR) AS id, arg_max(event_type, event_id) AS status, CAST(max(event_id) AS VARCHAR) AS last_try, CAST(max(event_id) FILTER (event_type = 'ok') AS VARCHAR) AS last_success FROM (SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'ok' ELSE event_type END AS event_type FROM events) GROUP BY 1""")
def source_states(t):
    e = t("events").select(F.col("user_id").cast("string").alias("source_id"), F.col("event_id").alias("at"), F.when(F.col("event_type").isin("view", "click"), "ok").otherwise(F.col("event_type")).alias("status"),
                           F.lit("").alias("error"), F.lit("").alias("pause_until"))
    s = e.select(F.col("source_id").alias("id")).distinct().select("id", F.lit("nie").alias("status"), F.lit("").alias("error"), F.lit("").alias("pause_until"), F.lit(None).cast("long").alias("last_try"), F.lit(None).cast("long").alias("last_success"))
    return T.source_states(s, e).select("id", "status", F.col("last_try").cast("string").alias("last_try"), F.col("last_success").cast("string").alias("last_success"))
