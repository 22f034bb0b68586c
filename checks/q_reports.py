"""Load reports: events as runs and attempts, orders and line items as stored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from townledger.operators import reports as R

from . import bindings as B
from .base import query, with_ctes

# Runs: every event of a user is a run of that source; 'error' and 'signup' are failures.
RUNS = "SELECT CAST(user_id AS VARCHAR) AS source_id, event_id AS id, CASE event_type WHEN 'error' THEN 'gesperrt' WHEN 'signup' THEN 'nicht erreichbar' WHEN 'click' THEN 'teilweise' ELSE 'ok' END AS status, ts, value FROM events"


def runs(t):
    status = F.when(F.col("event_type") == "error", "gesperrt").when(F.col("event_type") == "signup", "nicht erreichbar").when(F.col("event_type") == "click", "teilweise").otherwise("ok")
    n = F.col("value").cast("int").cast("bigint")
    return t("events").select(F.col("user_id").cast("string").alias("source_id"), F.col("event_id").alias("id"), status.alias("status"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("started"),
                              F.date_format(F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("value").cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ended"), F.lit(1).alias("requests"),
                              F.map_from_arrays(F.array(F.lit("opendata:neu"), F.lit("verfahren:gespeichert"), F.lit("eigen:art_x")), F.array(n, n + 1, F.lit(5).cast("bigint"))).alias("counters"), F.lit("").alias("error"))


def source_rows(t):
    """One source per user, with its last attempt."""
    last = runs(t).groupBy(F.col("source_id").alias("id")).agg(F.max_by("status", "id").alias("status"), F.max("started").alias("last_try"))
    k = F.col("id").cast("int")
    return last.select("id", F.lit(B.CITY).alias("city"), F.concat(F.lit("Quelle "), "id").alias("name"), F.element_at(F.array(*[F.lit(x) for x in ("oparl", "bauleitplanung", "bekanntmachungen", "opendata", "beteiligung", "presse-rss", "demo")]), (k % 7 + 1).cast("int")).alias("type"),
                       (k % 13 == 0).alias("sample"), "status", F.lit("").alias("error"), "last_try", F.when(k % 2 == 0, F.col("last_try")).otherwise("").alias("last_success"),
                       F.when(k % 11 == 0, "2024-02-01T00:00:00Z").when(k % 5 == 0, "2024-01-05T00:00:00Z").otherwise("").alias("pause_until"))


SRC = f"""SELECT source_id AS id, CAST(source_id AS INTEGER) AS k, arg_max(status, id) AS status, date_trunc('second', max(ts)) AS last_try FROM ({RUNS}) GROUP BY 1"""


def stored(t):
    """Records per user source from orders, meetings from customers, documents from line items."""
    o, li = t("orders"), t("lineitem")
    k = F.col("o_orderkey")
    users = lambda c: (F.col(c) % 150).cast("string")
    kind = F.when(k % 3 == 0, "Bekanntmachung").when(k % 3 == 1, "Beteiligungsangebot").otherwise("Antrag")
    docs = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey").cast("string")).otherwise("").alias("record_id"),
                     F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("m"), F.col("l_partkey"))).otherwise("").alias("meeting_id"), F.concat(F.lit("Doc "), F.col("l_suppkey")).alias("name"),
                     F.when(F.col("l_returnflag") == "R", "vorlage").when(F.col("l_returnflag") == "A", "").otherwise("sonst").alias("role"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
                     F.lit("u").alias("url"), (F.col("l_quantity") > 45).alias("deleted"))
    return {
        "records": o.select(k.cast("string").alias("id"), users("o_custkey").alias("source_id"), kind.alias("kind"), (F.col("o_orderstatus") == "P").alias("deleted")),
        "meetings": t("customer").select(F.concat(F.lit("m"), F.col("c_custkey")).alias("id"), users("c_custkey").alias("source_id"), (F.col("c_mktsegment") == "BUILDING").alias("deleted")),
        "committees": t("supplier").select(F.col("s_suppkey").alias("id"), users("s_suppkey").alias("source_id"), F.lit(False).alias("deleted")),
        "agenda_items": li.select(F.concat(F.lit("m"), F.col("l_suppkey")).alias("meeting_id"), (F.col("l_returnflag") == "N").alias("deleted")),
        "consultations": li.select(F.col("l_orderkey").cast("string").alias("record_id"), (F.col("l_returnflag") == "N").alias("deleted")),
        "documents": docs, "plans": o.filter(k % 4 == 0).select(k.cast("string").alias("id")), "snapshots": li.select(F.col("l_orderkey").cast("string").alias("id")),
        "hints": t("events").select(F.col("user_id").cast("string").alias("source_id")), "entries": o.filter(k % 2 == 0).select(k.cast("string").alias("id")),
        "runs": runs(t), "sources": source_rows(t),
        "cursors": t("customer").select(users("c_custkey").alias("source_id"), F.concat(F.lit("e"), F.col("c_custkey")).alias("entity"), F.lit("x").alias("modified_since"), F.lit("y").alias("updated"),
                                        F.when(F.col("c_custkey") % 7 == 0, "https://n").otherwise("").alias("next_url"), F.lit("").alias("series_start")),
        "detail_queue": o.filter(k % 50 == 0).select(users("o_custkey").alias("source_id"), k.alias("record_id"))}


DOCS = """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, CASE WHEN l_linenumber % 2 = 0 THEN CAST(o_custkey % 150 AS VARCHAR) ELSE CAST(c_custkey % 150 AS VARCHAR) END AS source_id,
  CASE l_returnflag WHEN 'R' THEN 'vorlage' WHEN 'A' THEN 'dokument' ELSE 'sonst' END AS role, 'Doc ' || l_suppkey AS name, strftime(l_shipdate, '%Y-%m-%d') AS date,
  CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_orderkey AS VARCHAR) ELSE '' END AS record_id, CASE WHEN l_linenumber % 2 = 1 THEN 'm' || l_partkey ELSE '' END AS meeting_id
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = l_partkey WHERE l_quantity <= 45"""


@query("totals", """SELECT 'records' AS table_name, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'meetings', count(*) FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 'committees', count(*) FROM supplier
  UNION ALL SELECT 'agenda_items', count(*) FROM lineitem WHERE l_returnflag <> 'N' UNION ALL SELECT 'consultations', count(*) FROM lineitem WHERE l_returnflag <> 'N' UNION ALL SELECT 'documents', count(*) FROM lineitem WHERE l_quantity <= 45""")
def totals(t):
    s = stored(t)
    return R.totals({n: s[n] for n in ("records", "meetings", "committees", "agenda_items", "consultations", "documents")})


ORD = "SELECT CAST(o_custkey % 150 AS VARCHAR) AS source_id, o_orderkey AS k, o_orderstatus <> 'P' AS live, o_orderkey % 3 AS m FROM orders"
COUNTS = f"""SELECT u AS source_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in R.COUNTERS)} FROM (SELECT DISTINCT CAST(x AS VARCHAR) AS u FROM (SELECT user_id AS x FROM events UNION SELECT o_custkey % 150 FROM orders UNION SELECT c_custkey % 150 FROM customer UNION SELECT s_suppkey % 150 FROM supplier))
  LEFT JOIN (SELECT source_id AS u, count(*) FILTER (live) AS records, count(*) FILTER (live AND k % 4 = 0) AS plans, count(*) FILTER (live AND k % 2 = 0) AS entries, count(*) FILTER (live AND k % 2 = 0 AND m = 0) AS notices, count(*) FILTER (live AND k % 2 = 0 AND m = 1) AS participations FROM ({ORD}) GROUP BY 1) USING (u)
  LEFT JOIN (SELECT CAST(c_custkey % 150 AS VARCHAR) AS u, count(*) FILTER (c_mktsegment <> 'BUILDING') AS meetings FROM customer GROUP BY 1) USING (u)
  LEFT JOIN (SELECT CAST(s_suppkey % 150 AS VARCHAR) AS u, count(*) AS committees FROM supplier GROUP BY 1) USING (u)
  LEFT JOIN (SELECT CAST(c_custkey % 150 AS VARCHAR) AS u, count(*) AS agenda_items FROM lineitem JOIN customer ON c_custkey = l_suppkey WHERE l_returnflag <> 'N' GROUP BY 1) USING (u)
  LEFT JOIN (SELECT CAST(o_custkey % 150 AS VARCHAR) AS u, count(*) FILTER (l_returnflag <> 'N') AS consultations, count(*) AS snapshots FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1) USING (u)
  LEFT JOIN (SELECT source_id AS u, count(*) AS documents FROM ({DOCS}) GROUP BY 1) USING (u) LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS u, count(*) AS hints FROM events GROUP BY 1) USING (u)"""


@query("counts_by_source", COUNTS)
def counts_by_source(t):
    return R.counts_by_source(stored(t))


@query("roles_by_source", f"SELECT coalesce(source_id, '') AS source_id, role, count(*) AS n, CASE role WHEN 'vorlage' THEN 0 WHEN 'dokument' THEN 8 ELSE 99 END AS role_rank, CASE role WHEN 'vorlage' THEN 'Vorlage' ELSE 'Dokument' END AS role_text FROM ({DOCS}) GROUP BY 1, 2")
def roles_by_source(t):
    s = stored(t)
    return R.documents_by_role(s["documents"], s["records"], s["meetings"])


@query("roles_overall", f"SELECT role, count(*) AS n FROM ({DOCS}) GROUP BY 1")
def roles_overall(t):
    s = stored(t)
    return R.roles_overall(R.documents_by_role(s["documents"], s["records"], s["meetings"])).select("role", "n")


@query("newest_documents", f"SELECT source_id, id, position FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY date DESC, name, id, record_id, meeting_id) AS position FROM ({DOCS}) WHERE source_id IS NOT NULL) WHERE position <= 25")
def newest_documents(t):
    s = stored(t)
    return R.newest_documents(s["documents"], s["records"], s["meetings"]).select("source_id", "id", F.col("position").cast("long").alias("position"))


@query("records_by_source", f"SELECT id, coalesce(n, 0) AS n FROM ({SRC}) LEFT JOIN (SELECT source_id, count(*) AS n FROM ({ORD}) WHERE live GROUP BY 1) ON source_id = id")
def records_by_source(t):
    return R.records_by_source(stored(t)["records"], source_rows(t)).select("id", "n")


STATE = """CASE WHEN k % 13 = 0 THEN 'beispiel' WHEN k % 11 = 0 THEN 'pause' WHEN status IN ('gesperrt', 'nicht erreichbar') THEN 'fehler' WHEN status = 'teilweise' THEN 'teilweise' ELSE 'aktuell' END"""


@query("load_state", f"SELECT id, {STATE} AS state FROM ({SRC})")
def load_state(t):
    return R.load_state(source_rows(t), R.counts_by_source(stored(t)), "2024-01-15T00:00:00Z").select("id", "state")


@query("latest_runs", f"SELECT source_id, id, position FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id DESC) AS position FROM ({RUNS})) WHERE position <= 8")
def latest_runs(t):
    return R.latest_runs(runs(t)).select("source_id", "id", F.col("position").cast("long").alias("position"))


@query("run_log", """SELECT event_id AS id, CAST(trunc(value) AS BIGINT) AS seconds, CASE WHEN v < 4 THEN 'Eigen art x=5,Verfahren übernommen=' || (v + 1) || ',Datenzeilen neu übernommen=' || v WHEN v = 4 THEN 'Eigen art x=5,Verfahren übernommen=5,Datenzeilen neu übernommen=4'
  WHEN v = 5 THEN 'Verfahren übernommen=6,Datenzeilen neu übernommen=5,Eigen art x=5' ELSE 'Verfahren übernommen=' || (v + 1) || ',Datenzeilen neu übernommen=' || v || ',Eigen art x=5' END AS counters FROM (SELECT *, CAST(trunc(value) AS BIGINT) AS v FROM events)""")
def run_log(t):
    log = R.run_log(runs(t))
    return log.select("id", "seconds", F.array_join(F.transform("counter_list", lambda c: F.concat(c["text"], F.lit("="), c["n"].cast("string"))), ",").alias("counters"))


FAILS = f"""SELECT source_id, CAST(coalesce(min(position) FILTER (status NOT IN ('gesperrt', 'nicht erreichbar')) - 1, max(position)) AS INTEGER) AS failures FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id DESC) AS position FROM ({RUNS})) GROUP BY 1"""


@query("consecutive_failures", FAILS)
def consecutive_failures(t):
    return R.consecutive_failures(runs(t))


@query("cool_down", f"""SELECT id, coalesce(w, 0) AS wait_seconds, CASE WHEN w IS NOT NULL THEN strftime(greatest(last_try + to_seconds(w), CASE WHEN k % 11 = 0 THEN TIMESTAMP '2024-02-01' WHEN k % 5 = 0 THEN TIMESTAMP '2024-01-05' END), '%Y-%m-%d %H:%M:%S') END AS not_before
  FROM (SELECT s.*, CASE WHEN s.status IN ('gesperrt', 'nicht erreichbar') THEN CAST(least(21600, 600 * pow(2, greatest(failures, 1) - 1)) AS INTEGER) END AS w FROM ({SRC}) s LEFT JOIN ({FAILS}) ON source_id = id)""")
def cool_down(t):
    df = R.cool_down(source_rows(t), R.consecutive_failures(runs(t)))
    return df.select("id", F.coalesce("wait_seconds", F.lit(0)).alias("wait_seconds"), F.date_format("not_before", "yyyy-MM-dd HH:mm:ss").alias("not_before"))


@query("next_due", f"SELECT id, strftime(greatest(last_try + INTERVAL 6 HOUR, CASE WHEN k % 11 = 0 THEN TIMESTAMP '2024-02-01' WHEN k % 5 = 0 THEN TIMESTAMP '2024-01-05' END), '%Y-%m-%d %H:%M:%S') AS next_due FROM ({SRC})")
def next_due(t):
    return R.next_due(source_rows(t), 21_600).select("id", F.date_format("next_due", "yyyy-MM-dd HH:mm:ss").alias("next_due"))


DEMAND = """WITH RECURSIVE e AS (SELECT DISTINCT user_id AS u, epoch(date_trunc('second', ts))::BIGINT AS s FROM events),
walk AS (SELECT u, min(s) AS s FROM e GROUP BY u UNION ALL SELECT w.u, (SELECT min(n.s) FROM e n WHERE n.u = w.u AND n.s >= w.s + {gap}) FROM walk w WHERE EXISTS (SELECT 1 FROM e n WHERE n.u = w.u AND n.s >= w.s + {gap}))
SELECT CAST(u AS VARCHAR) AS city, strftime(to_timestamp(min(s))::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS first_at, strftime(to_timestamp(max(s))::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS last_at, count(*) AS n FROM walk GROUP BY u"""


def demands(t, gap=600):
    return R.demand(t("events").select(F.col("user_id").cast("string").alias("city"), F.col("ts").alias("at")), gap)


def shown(df):
    return df.select("city", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_at", "last_at")], "n")


@query("demand_fold", DEMAND.format(gap=600))
def demand_fold(t):
    return shown(demands(t))


@query("demand_fold_wide", DEMAND.format(gap=43_200))
def demand_fold_wide(t):
    """A gap of half a day, at which most requests are repeats."""
    return shown(demands(t, 43_200))


LAST = "SELECT CAST(user_id AS VARCHAR) AS city, date_trunc('second', max(ts)) AS last_at FROM events GROUP BY 1"


@query("active_cities", DEMAND.format(gap=600).replace("SELECT CAST(u AS VARCHAR) AS city, strftime", ", d AS (SELECT CAST(u AS VARCHAR) AS city, strftime", 1) + """)
SELECT city, row_number() OVER (ORDER BY last_at DESC, city DESC) AS position, strftime(strptime(last_at, '%Y-%m-%d %H:%M:%S') + INTERVAL 5 DAY, '%Y-%m-%d %H:%M:%S') AS valid_until FROM d WHERE CAST(city AS INTEGER) % 2 = 0 AND last_at >= '2024-01-25 12:00:00' QUALIFY position <= 12""")
def active_cities(t):
    cities = t("events").select(F.col("user_id").cast("string").alias("city")).distinct().withColumn("on_demand", F.col("city").cast("int") % 2 == 0)
    a = R.active_cities(demands(t), cities, "2024-01-30 12:00:00", 5, 12)
    return a.select("city", F.col("position").cast("long").alias("position"), F.date_format("valid_until", "yyyy-MM-dd HH:mm:ss").alias("valid_until"))


@query("city_overview", with_ctes("quarters", "districts", "postcodes", "records", body="""SELECT city, position, name, is_default, on_demand, state, stock, level, n_quarters, n_postcodes, example_postcode FROM (
  SELECT row_number() OVER (ORDER BY r_regionkey > 0, r_name) AS position, 'stadt' || CASE WHEN r_regionkey > 0 THEN CAST(r_regionkey AS VARCHAR) ELSE '' END AS city, CASE WHEN r_regionkey = 0 THEN 'Stadt' ELSE r_name END AS name, r_regionkey = 0 AS is_default, r_regionkey > 0 AS on_demand,
  CASE WHEN r_regionkey = 0 THEN 'aktiv' WHEN (SELECT max(ts) FROM events WHERE user_id % 3 + 1 = r_regionkey) >= TIMESTAMP '2024-01-17 00:00:00' THEN 'laedt' ELSE 'ruht' END AS state, CASE WHEN r_regionkey = 0 THEN (SELECT count(*) FROM records) ELSE 0 END AS stock, CASE WHEN r_regionkey = 0 THEN 'voll' ELSE 'keine' END AS level,
  CASE WHEN r_regionkey = 0 THEN (SELECT count(*) FROM quarters) ELSE 0 END AS n_quarters, CASE WHEN r_regionkey = 0 THEN (SELECT count(DISTINCT plz) FROM postcodes) ELSE 0 END AS n_postcodes, CASE WHEN r_regionkey = 0 THEN (SELECT min(plz) FROM postcodes) ELSE '' END AS example_postcode FROM region)"""))
def city_overview(t):
    d = B.dims(t)
    src = B.sources(t).withColumn("last_success", F.lit("x"))
    dem = R.demand(t("events").select(F.concat(F.lit("stadt"), F.col("user_id") % 3 + 1).alias("city"), F.col("ts").alias("at")))
    out = R.city_overview(d, src, B.all_records(t), dem, "2024-01-31 00:00:00", B.CITY, days=14, maximum=3)
    return out.select("city", F.col("position").cast("long").alias("position"), "name", "is_default", "on_demand", "state", "stock", "level", "n_quarters", "n_postcodes", "example_postcode")


@query("configured_sources", f"SELECT id, city, name, configured, status FROM (SELECT id, 'stadt' AS city, 'Quelle ' || id AS name, k % 3 = 0 AS configured, status FROM ({SRC}) UNION ALL SELECT 'neu' || c_custkey, 'stadt', 'Neu', true, 'nie' FROM customer WHERE c_custkey % 100 = 0)")
def configured_sources(t):
    s = source_rows(t)
    conf = s.filter("cast(id as int) % 3 = 0").select("id", "city", "type", F.lit("K").alias("name"), F.col("id").cast("int").alias("pos")).unionByName(
        t("customer").filter("c_custkey % 100 = 0").select(F.concat(F.lit("neu"), F.col("c_custkey")).alias("id"), F.lit(B.CITY).alias("city"), F.lit("oparl").alias("type"), F.lit("Neu").alias("name"), F.col("c_custkey").cast("int").alias("pos")))
    return R.configured_and_stored(conf, s).select("id", "city", "name", "configured", "status")


def report(t):
    s = stored(t)
    conf = s["sources"].select("id", "city", "type", "name", F.col("id").cast("int").alias("pos"))
    return R.load_report(s, conf, "2024-01-15T00:00:00Z")


@query("load_report", f"""SELECT id, {STATE} AS state, records, documents, (SELECT count(*) FROM orders WHERE o_orderkey % 50 = 0 AND CAST(o_custkey % 150 AS VARCHAR) = s.id) AS n_open, 8 AS n_runs, least(c.documents, 25) AS n_documents FROM ({SRC}) s JOIN ({COUNTS}) c ON c.source_id = s.id""")
def load_report(t):
    return report(t).select("id", "state", "records", "documents", "n_open", F.size("runs").alias("n_runs"), F.size("newest_documents").cast("long").alias("n_documents"))


@query("load_path", f"""SELECT id, CASE WHEN k % 7 IN (4) THEN 5 WHEN k % 7 = 3 THEN 6 WHEN k % 7 IN (5, 6) THEN 4 ELSE 5 END AS n_steps, CASE WHEN k % 7 = 5 THEN 'Hinweise' WHEN k % 7 = 6 THEN 'Beispieldaten' WHEN k % 7 = 0 THEN 'Listen' WHEN k % 7 = 1 THEN 'Verfahrensliste' WHEN k % 7 = 2 THEN 'Listen' WHEN k % 7 = 3 THEN 'Datensätze' ELSE 'Projekte' END AS second,
  records || CASE WHEN records = 1 THEN ' Vorgang' ELSE ' Vorgänge' END || ' · ' || plans || ' Planverfahren' AS stock FROM ({SRC}) s JOIN ({COUNTS}) c ON c.source_id = s.id""")
def load_path(t):
    p = report(t)
    return p.select("id", F.size("path").alias("n_steps"), F.element_at("path", 2)["step"].alias("second"), F.element_at("path", -1)["value"].alias("stock"))


@query("report_totals", f"SELECT 'stadt' AS city, CAST(sum(records) AS BIGINT) AS records, CAST(sum(documents) AS BIGINT) AS documents, count(*) AS sources, count(*) FILTER (k % 13 <> 0) AS live_sources, 2 AS n_hints FROM ({SRC}) s JOIN ({COUNTS}) c ON c.source_id = s.id")
def report_totals(t):
    return R.report_totals(report(t)).select("city", "records", "documents", "sources", "live_sources", F.size("hints").alias("n_hints"))


@query("ingest_counters", 'SELECT count(*) FILTER (o_orderkey % 2 = 0) AS "new", count(*) FILTER (o_orderkey % 2 <> 0) AS updated, count(*) FILTER (o_orderkey % 3 = 0) AS without_date, count(*) FILTER (o_custkey % 4 = 0) AS without_place FROM orders')
def ingest_counters(t):
    k = F.col("o_orderkey")
    return R.ingest_counters(t("orders").select((k % 2 == 0).alias("is_new"), F.when(k % 3 == 0, "").otherwise("x").alias("date"), (F.col("o_custkey") % 4).alias("n_places")))
