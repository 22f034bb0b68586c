"""Whole loads, place maintenance, answers, and the streaming jobs with their batch twins' SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from townledger.operators import tables as T
from townledger.plans import answer as A
from townledger.plans import ingest as I
from townledger.streaming import jobs as J

from . import bindings as B
from . import q_sources as Q
from .base import query, with_ctes
from .q_questions import questions
from .q_reports import DEMAND, shown
from .q_tables import CHANGED

SEEN = "2026-10-12T00:00:00+00:00"


def src(t, *ids):
    return t("region").sparkSession.createDataFrame([(i, B.CITY) for i in ids], "id string, city string")


@query("ingest_council", with_ctes("postcodes", body=f"SELECT DISTINCT 'p/' || o_orderkey AS id, 'plz' AS type, plz AS key, 'oparl' AS provenance FROM orders JOIN postcodes ON plz = CAST(50000 + o_custkey % 60 AS VARCHAR) WHERE o_orderkey % 20 <> 0 AND {Q.HAS}"))
def ingest_council(t):
    return I.ingest_council(Q.objects(t), B.dims(t))["places"]


@query("merge_council", f"""SELECT 'records' AS table_name, count(*) AS n FROM orders WHERE o_orderkey % 20 <> 0 AND {Q.HAS} UNION ALL SELECT 'consultations', count(*) FROM lineitem WHERE l_orderkey % 20 <> 0 AND l_orderkey IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'documents', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey % 3 FROM lineitem WHERE l_orderkey % 20 <> 0 AND l_orderkey IN (SELECT o_orderkey FROM orders))""")
def merge_council(t):
    """The same load applied twice leaves one copy of everything."""
    load = I.ingest_council(Q.objects(t), B.dims(t))
    names = ("committees", "records", "meetings", "consultations", "agenda_items", "documents", "relations", "places")
    once = I.merge_council({n: load[n].limit(0) for n in names}, load)
    twice = I.merge_council(once, load)
    return _sizes({n: twice[n] for n in ("records", "consultations", "documents")})


def _sizes(tables):
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def plans_load(t):
    details = t("pages").select(F.col("page_id").cast("string").alias("record_id"), "url", "html")
    return I.ingest_plans(Q.plan_pages(t), details, B.dims(t), src(t, "stadt:plan"), "Stadt Köln", "https://plan.example/{id}", "r1", SEEN)


GOOD = f"SELECT * FROM ({Q.PLAN}) WHERE bad = 0 AND k % 4 <> 0 AND k % 10 <> 7 QUALIFY row_number() OVER (PARTITION BY k % 7000 ORDER BY page_no DESC) = 1"


@query("ingest_plans", f"""SELECT 'https://plan.example/v' || k % 7000 AS id, strftime(o_orderdate, '%Y-%m-%d') AS date, 'plan ' || k || ' bauleitplanung ' || CASE WHEN k % 3 = 0 THEN 'beteiligung oeffentlichkeit' ELSE 'verfahrensphase unbekannt' END || ' a b' AS search_text, 'offen' AS detail_status FROM ({GOOD})""")
def ingest_plans(t):
    load = plans_load(t)
    return load["records"].select("id", "date", "search_text").join(load["plans"].select("id", "detail_status"), "id")


@query("plan_snapshots", f"""SELECT 'https://plan.example/v' || k % 7000 AS id, sha256('{{"begin":"' || strftime(o_orderdate, '%Y-%m-%d') || '","description":"A & B","end":"' || strftime(o_orderdate + INTERVAL (CASE WHEN k % 997 = 0 THEN -5 ELSE 20 END) DAY, '%Y-%m-%d') || '","organisation":"Stadt Köln","permission":"' || CASE WHEN k % 4 = 1 THEN 'write' ELSE '' END
  || '","phase":"' || CASE WHEN k % 3 = 0 THEN 'Beteiligung Öffentlichkeit' ELSE 'Verfahrensphase unbekannt' END || '","title":"Plan ' || k || '"}}') AS content_hash FROM ({GOOD})""")
def plan_snapshots(t):
    return plans_load(t)["snapshots"].select("id", "content_hash")


@query("ingest_notices", 'SELECT count(*) FILTER (o_orderkey % 2 <> 0) AS "new", count(*) FILTER (o_orderkey % 2 = 0) AS updated, count(*) FILTER (o_orderkey % 5 = 0) AS without_date, count(*) AS without_place FROM orders WHERE o_orderkey % 9 <> 0')
def ingest_notices(t):
    known = t("orders").filter("o_orderkey % 2 = 0").select(F.concat(F.lit("bekanntmachung:"), F.lpad(F.col("o_orderkey") % 1000, 4, "0"), F.lit("-01_"), "o_orderkey").alias("id"))
    return I.ingest_notices(Q.notice_pages(t), B.dims(t), src(t, "stadt:amtsblatt"), SEEN, known)["counters"]


@query("ingest_participation", 'SELECT count(*) AS "new", 0::BIGINT AS updated, count(*) AS without_date, count(*) AS without_place FROM part WHERE p_partkey % 7 <> 0')
def ingest_participation(t):
    return I.ingest_participation(Q.card_pages(t), B.dims(t), src(t, "stadt:beteiligung"), SEEN)["counters"]


@query("ingest_open_data", "SELECT 's' || s_suppkey % 4 AS source_id, CASE WHEN s_suppkey % 6 = 2 THEN 'licence' WHEN s_suppkey % 2 = 0 OR s_suppkey % 5 = 0 THEN 'taken' ELSE 'no table' END AS verdict, count(*) AS n FROM supplier GROUP BY 1, 2")
def ingest_open_data(t):
    cat, ans, want = Q.catalogue_rows(t), Q.answers(t), Q.all_wanted(t)
    return I.ingest_open_data(cat, ans, want, B.dims(t), src(t, "s0", "s1", "s2", "s3"), "2000-01-01", SEEN)["verdicts"]


@query("ingest_open_data_records", f"SELECT 'opendata:id' || l_suppkey || ':' || {Q.ROWKEY} AS id, 's' || l_suppkey % 4 AS source_id, strftime(max(l_shipdate), '%Y-%m-%d') AS date FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey % 6 <> 2 AND (s_suppkey % 2 = 0 OR s_suppkey % 5 = 0) GROUP BY 1, 2")
def ingest_open_data_records(t):
    cat, ans, want = Q.catalogue_rows(t), Q.answers(t), Q.all_wanted(t)
    load = I.ingest_open_data(cat, ans, want, B.dims(t), src(t, "s0", "s1", "s2", "s3"), "2000-01-01", SEEN)
    return load["records"].select("id", "source_id", "date")


@query("ingest_feeds", "SELECT CAST(user_id AS VARCHAR) AS source_id, count(*) AS n FROM events WHERE CASE WHEN user_id % 2 = 0 THEN event_id % 5 <> 0 ELSE event_id % 4 <> 0 END GROUP BY 1")
def ingest_feeds(t):
    return I.ingest_feeds(Q.feed_pages(t), SEEN)["hints"].groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query("ingest_samples", f"SELECT 'p/' || o_orderkey AS id FROM orders WHERE o_orderkey % 20 <> 0 AND {Q.HAS} AND o_orderkey % 3 <> 0")
def ingest_samples(t):
    """A third of the papers is stored from a real source already."""
    real = t("orders").filter("o_orderkey % 3 = 0").select(F.concat(F.lit("p/"), "o_orderkey").alias("id"), F.lit("stadt:echt").alias("source_id"))
    sources = t("region").sparkSession.createDataFrame([("stadt:ris", True), ("stadt:echt", False)], "id string, sample boolean")
    return I.ingest_samples(Q.objects(t), B.dims(t), real, sources)["records"].select("id")


def recomputed(t):
    d = B.dims(t)
    rec = B.live_records(t)
    entries = rec.limit(0).select("id", F.lit("").alias("short_text"), F.lit("").alias("category"), F.lit("").alias("step"))
    plans = rec.select("id", F.col("text").alias("description"))
    old = B.places(t, d).drop("city").filter("cast(id as int) % 3 <> 0").unionByName(rec.select("id", F.lit("plz").alias("type"), F.lit("99999").alias("key"), F.lit("oparl").alias("provenance")))
    return I.recompute_places(rec, entries, plans, old, d)


@query("recompute_counters", with_ctes("places", "records", body="SELECT count(DISTINCT id) AS updated, count(*) AS added, 0::BIGINT AS from_street, (SELECT count(*) FROM records) AS checked FROM places WHERE CAST(id AS INTEGER) % 3 = 0"))
def recompute_counters(t):
    return recomputed(t)[2]


@query("recompute_places", with_ctes("places", "records", body="SELECT id, type, key, provenance FROM places UNION ALL SELECT id, 'plz', '99999', 'oparl' FROM records"))
def recompute_places(t):
    return recomputed(t)[0]


@query("answer_questions")
def answer_questions(t):
    """All user turns to result pages with status, summary and timeline; its parts are checked one by one."""
    from .q_timeline import frames
    cons, _, meet, items, com = frames(t)
    rec = B.all_records(t)
    sources = B.sources(t).select("id", "city", F.col("id").alias("name"), F.lit("oparl").alias("type"), F.lit(False).alias("sample"), F.lit("https://rat.example/vo?id={id}").alias("web_record"), F.lit("https://rat.example/si?id={id}").alias("web_meeting"))
    k = F.col("id").cast("int")
    plans = rec.filter(k % 7 == 0).select("id", F.col("kind").alias("phase"), F.lit("2026-01-01").alias("begin"), F.lit("2026-12-01").alias("end"), F.col("text").alias("description"), F.lit("Amt").alias("organisation"),
                                          F.lit("write").alias("permission"), F.lit("2026-10-01").alias("seen"), F.lit(True).alias("listed"), F.lit("ok").alias("detail_status"))
    entries = rec.filter(k % 7 == 1).select("id", F.lit("K").alias("category"), F.lit("").alias("step"), F.lit("amtlich").alias("short_status"), F.lit("Text.").alias("status_text"), F.lit(False).alias("open"), F.col("title").alias("short_text"), F.lit("").alias("extra"), F.lit("2026-10-01").alias("seen"))
    snaps = plans.select("id", F.lit(1).alias("seq"), F.lit("2026-10-01T08:00:00Z").alias("observed"), F.struct(F.lit("T").alias("title"), "phase", "begin", "end", "description", "organisation", "permission").alias("content"))
    docs = t("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").cast("string").alias("record_id"), F.lit("").alias("meeting_id"), F.lit("Doc").alias("name"), F.lit("vorlage").alias("role"), F.lit("").alias("date"), F.lit("u").alias("url"), F.lit(False).alias("deleted"))
    tables = {"records": rec, "sources": sources, "consultations": cons, "meetings": meet, "agenda_items": items, "committees": com, "plans": plans, "entries": entries, "snapshots": snaps, "documents": docs, "places": B.places(t).drop("city")}
    from .q_search import press
    out = A.answer(questions(t), tables, B.dims(t), B.TODAY, "2026-10-12 10:00:00", press(t), limit=3)
    return out.select("request_id", "rank", "id", "score", "total", F.col("status.short").alias("status"), F.size("timeline").alias("n_events"), F.size("hints").alias("n_hints"), "summary", F.col("links.original").alias("link"))


# --- streams ------------------------------------------------------------------------

UPSERTED = "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority FROM orders GROUP BY 1"


FILE_ROWS = 1_000_000


def overlapping(t, df, key, parts=4):
    """The rows as a folder of files that overlap by half, as many files a batch as a part has (one per FILE_ROWS rows), later rows partly first."""
    path = t.scratch()
    files = df.count() // FILE_ROWS + 1
    k = F.pmod(F.xxhash64(key), F.lit(2 * parts))
    for i in (*range(1, parts), 0, parts - 1):
        df.filter((k >= 2 * i - 1) & (k <= 2 * i + 1)).repartition(files).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def upserted(t, stream):
    path, ck = t.scratch(), t.scratch()
    J.stream_upsert(stream, path, ["o_custkey"], ["o_orderdate", "o_orderkey"], ck).awaitTermination()
    return J.current_rows(t("region").sparkSession, path, ["o_custkey"]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("stream_upsert", UPSERTED)
def stream_upsert(t):
    return upserted(t, t.stream("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority"))


@query("stream_upsert_overlap", UPSERTED)
def stream_upsert_overlap(t):
    """The same rows in several files that overlap."""
    return upserted(t, overlapping(t, t("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority"), "o_orderkey"))


@query("stream_changes", CHANGED)
def stream_changes(t):
    history, ck = t.scratch(), t.scratch()
    e = t.stream("events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type", (F.col("value") > 50).alias("big"), "ts")
    J.stream_changes(T.content_hash(e, ["event_type", "big"]), history, ck).awaitTermination()
    return t("region").sparkSession.read.parquet(history).select("id", "seq")


@query("stream_closure", """WITH seen AS (SELECT user_id % 10 AS s, user_id AS id, max(strftime(ts, '%Y-%m-%d')) AS run FROM events WHERE event_type <> 'error' GROUP BY 1, 2), done AS (SELECT user_id % 10 AS s, max(strftime(ts, '%Y-%m-%d')) AS run FROM events WHERE event_type = 'error' AND user_id % 3 = 0 GROUP BY 1)
  SELECT CAST(seen.s AS VARCHAR) AS source_id, id, done.run IS NULL OR seen.run >= done.run AS listed FROM seen LEFT JOIN done USING (s)""")
def stream_closure(t):
    """Days are runs; an error event of every third user marks the end of its source's run. The files overlap."""
    path, ck = t.scratch(), t.scratch()
    marker = F.col("event_type") == "error"
    rows = t("events").filter(~marker | (F.col("user_id") % 3 == 0)).select((F.col("user_id") % 10).cast("string").alias("source_id"), F.col("user_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("run_id"), marker.alias("marker"), "event_id")
    J.stream_closure(overlapping(t, rows, "event_id"), path, ck).awaitTermination()
    return J.listed_state(t("region").sparkSession.read.parquet(path)).select("source_id", "id", "listed")


@query("stream_demand", DEMAND.format(gap=600))
def stream_demand(t):
    """The events in files that overlap and do not follow their time."""
    path, ck = t.scratch(), t.scratch()
    rows = t("events").select(F.col("user_id").cast("string").alias("city"), F.col("ts").alias("at"), "event_id")
    J.stream_demand(overlapping(t, rows, "event_id"), path, ck).awaitTermination()
    return shown(J.demand_state(t("region").sparkSession, path))


@query("stream_annotate", with_ctes("places", body="SELECT id, type, key FROM places WHERE provenance = 'beschreibung'"))
def stream_annotate(t):
    path, ck = t.scratch(), t.scratch()
    s = t.stream("documents").filter("doc_id % 29 <> 0").select(F.lit(B.CITY).alias("city"), F.col("doc_id").cast("string").alias("id"), "text")
    J.stream_annotate(s, B.dims(t), path, ck, ("text", "beschreibung")).awaitTermination()
    return J.annotated(t("region").sparkSession, path).select("id", "type", "key")
