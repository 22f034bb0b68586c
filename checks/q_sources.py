"""Sources: the provided tables written as landed answers, then read back by the source jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from townledger.sources import council as C
from townledger.sources import feeds, notices, opendata, planning, registers

from . import bindings as B
from .base import query, with_ctes

PER_PAGE = 100


def pages_of(objects, page_key, keep=()):
    """JSON list pages of a bounded number of objects each (object column ``o``)."""
    body = F.to_json(F.struct(F.collect_list("o").alias("data"), F.struct(F.lit("?page=2").alias("next")).alias("links")))
    return objects.groupBy(page_key.alias("page_no"), *keep).agg(body.alias("body")).withColumn("url", F.concat(F.lit("https://rat.example/liste?page="), "page_no"))


def paper_pages(t):
    """Orders as papers; their line items as consultations, half of them bare addresses, and as files."""
    li = t("lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("f")).alias("l"))
    o = t("orders").join(li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l")).alias("ls")), F.col("o_orderkey") == F.col("l_orderkey"))
    cid = lambda l: F.concat_ws("/", F.lit("c"), F.col("o_orderkey"), l["n"], l["p"], l["s"])
    cons = F.transform("ls", lambda l: F.when(l["n"] % 2 == 0, F.to_json(F.struct(cid(l).alias("id"), F.concat(F.lit("m/"), l["s"]).alias("meeting"), F.array(F.concat(F.lit("g/"), l["p"])).alias("organization"),
                                                                                  l["f"].alias("role"), (l["f"] == "R").alias("authoritative")))).otherwise(F.to_json(F.array(cid(l)))))
    # Elements are JSON texts; a bare address comes as a one-element list and loses its brackets.
    cons = F.concat(F.lit("["), F.array_join(F.transform(cons, lambda c: F.regexp_replace(c, r"^\[|\]$", "")), ","), F.lit("]"))
    files = F.transform("ls", lambda l: F.struct(F.concat(F.lit("f/"), l["p"] % 3).alias("id"), F.when(l["n"] % 2 == 0, "Einladung zur Sitzung").otherwise("Niederschrift").alias("name"), F.concat(F.lit("u/"), l["s"]).alias("accessUrl")))
    obj = F.struct(F.concat(F.lit("p/"), "o_orderkey").alias("id"), F.lit("https://schema/Paper").alias("type"), F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("reference"),
                   F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(F.col("o_orderkey") % 20 == 0, F.lit(True)).alias("deleted"), F.lit("@cons@").alias("consultation"), files.alias("auxiliaryFile"),
                   F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("p/"), F.col("o_custkey"))).alias("relatedPaper"),
                   F.struct(F.concat(F.lit(""), 50000 + F.col("o_custkey") % 60).alias("postalCode"), F.when(F.col("o_orderkey") % 3 == 0, "Mitte").alias("subLocality")).alias("location"))
    text = F.replace(F.to_json(obj), F.lit('"@cons@"'), cons)
    body = F.concat(F.lit('{"data":['), F.array_join(F.collect_list("o"), ","), F.lit('],"links":{"next":"?page=2"}}'))
    rows = o.select(F.floor(F.col("o_orderkey") / PER_PAGE).alias("page_no"), text.alias("o"))
    return rows.groupBy("page_no").agg(body.alias("body")).withColumn("url", F.concat(F.lit("https://rat.example/liste?page="), "page_no"))


def objects(t):
    return C.council_objects(paper_pages(t)).withColumn("source_id", F.lit("stadt:ris")).withColumn("city", F.lit(B.CITY))


HAS = "o_orderkey IN (SELECT l_orderkey FROM lineitem)"


@query("council_papers", f"SELECT 'p/' || o_orderkey AS id, o_orderpriority AS title, CAST(o_custkey AS VARCHAR) AS reference, strftime(o_orderdate, '%Y-%m-%d') AS date, trim(regexp_replace(lower(o_orderpriority) || ' ' || o_custkey, '[^0-9a-z]+', ' ', 'g')) AS search_text FROM orders WHERE {HAS} AND o_orderkey % 20 <> 0")
def council_papers(t):
    return C.papers(objects(t)).select("id", "title", "reference", "date", "search_text")


@query("council_consultations", """SELECT 'c/' || l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS id, 'p/' || l_orderkey AS record_id, CASE WHEN l_linenumber % 2 = 0 THEN 'm/' || l_suppkey ELSE '' END AS meeting_id,
  CASE WHEN l_linenumber % 2 = 0 THEN 'g/' || l_partkey ELSE '' END AS committee_ids, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE '' END AS role, l_linenumber % 2 = 0 AND l_returnflag = 'R' AS authoritative FROM lineitem WHERE l_orderkey % 20 <> 0 AND l_orderkey IN (SELECT o_orderkey FROM orders)""")
def council_consultations(t):
    return C.consultations(objects(t)).select("id", "record_id", "meeting_id", F.array_join("committee_ids", ",").alias("committee_ids"), "role", "authoritative")


@query("file_first_wins", """SELECT 'f/' || l_partkey % 3 AS id, 'p/' || l_orderkey AS record_id, arg_min(CASE WHEN l_linenumber % 2 = 0 THEN 'einladung' ELSE 'protokoll' END, (l_linenumber, l_partkey, l_suppkey, l_returnflag)) AS role,
  arg_min('u/' || l_suppkey, (l_linenumber, l_partkey, l_suppkey, l_returnflag)) AS url FROM lineitem WHERE l_orderkey % 20 <> 0 AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2""")
def file_first_wins(t):
    return C.file_refs(objects(t)).select("id", "record_id", "role", "url")


@query("paper_relations", f"SELECT 'p/' || o_orderkey AS from_id, 'p/' || o_custkey AS to_id, 'verwandt' AS kind FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 20 <> 0 AND {HAS}")
def paper_relations(t):
    return C.paper_relations(objects(t))


@query("paper_locations", f"SELECT 'p/' || o_orderkey AS id, 'plz' AS type, CAST(50000 + o_custkey % 60 AS VARCHAR) AS value FROM orders WHERE o_orderkey % 20 <> 0 AND {HAS} UNION ALL SELECT 'p/' || o_orderkey, 'stadtteil_name', 'Mitte' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 20 <> 0 AND {HAS}")
def paper_locations(t):
    return C.paper_locations(objects(t)).select("id", "type", "value")


@query("deleted_objects", f"SELECT 'p/' || o_orderkey AS id FROM orders WHERE o_orderkey % 20 = 0 AND {HAS}")
def deleted_objects(t):
    return C.deleted_ids(objects(t), "Paper")


@query("council_counters", f"SELECT 'Paper' AS type, count(*) FILTER (o_orderkey % 20 <> 0) AS saved, count(*) FILTER (o_orderkey % 20 = 0) AS deleted FROM orders WHERE {HAS}")
def council_counters(t):
    from townledger.plans.ingest import council_counters as counters
    return counters(objects(t)).select("type", "saved", "deleted")


def meeting_pages(t):
    """Suppliers as meetings with the line items they deliver as agenda items, a few per meeting object."""
    li = t("lineitem").withColumn("m", F.concat_ws("-", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd")))
    item = F.struct(F.concat_ws("/", F.lit("a"), "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.col("l_linenumber").cast("string").alias("number"), F.col("l_linenumber").alias("order"), F.lit("TOP").alias("name"), F.col("l_returnflag").alias("result"),
                    (F.col("l_linestatus") == "O").alias("public"), F.struct(F.concat(F.lit("c/"), "l_partkey").alias("id")).alias("consultation"))
    m = li.groupBy("m", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(F.collect_list(item).alias("items"))
    obj = F.struct(F.concat(F.lit("m/"), "m").alias("id"), F.lit("x/Meeting").alias("type"), F.lit("Rat").alias("name"), F.concat("day", F.lit("T17:00:00+02:00")).alias("start"), (F.col("l_suppkey") % 5 == 0).alias("cancelled"),
                   F.struct(F.when(F.col("l_suppkey") % 2 == 0, "Saal").alias("room"), F.lit("50667").alias("postalCode"), F.lit("Stadt").alias("locality")).alias("location"), F.concat(F.lit("g/"), "l_suppkey").alias("organization"), F.col("items").alias("agendaItem"))
    return pages_of(m.select(obj.alias("o"), (F.xxhash64("m") % 1000).alias("b")), F.col("b"))


def meeting_objects(t):
    return C.council_objects(meeting_pages(t)).withColumn("source_id", F.lit("stadt:ris"))


@query("council_meetings", "SELECT DISTINCT 'm/' || l_suppkey || '-' || strftime(l_shipdate, '%Y-%m-%d') AS id, strftime(l_shipdate, '%Y-%m-%d') AS date, CASE WHEN l_suppkey % 2 = 0 THEN 'Saal, ' ELSE '' END || '50667 Stadt' AS place, l_suppkey % 5 = 0 AS cancelled, 'g/' || l_suppkey AS committee_ids FROM lineitem")
def council_meetings(t):
    return C.meetings(meeting_objects(t)).select("id", "date", "place", "cancelled", F.array_join("committee_ids", ",").alias("committee_ids"))


@query("council_agenda_items", "SELECT 'a/' || l_orderkey || '/' || l_linenumber || '/' || l_partkey AS id, 'm/' || l_suppkey || '-' || strftime(l_shipdate, '%Y-%m-%d') AS meeting_id, l_linenumber AS item_order, l_returnflag AS result, l_linestatus = 'O' AS public, 'c/' || l_partkey AS consultation_id FROM lineitem")
def council_agenda_items(t):
    return C.agenda_items(meeting_objects(t)).select("id", "meeting_id", "item_order", "result", "public", "consultation_id")


@query("council_organizations", "SELECT s_suppkey || '' AS id, s_name AS name, '' AS short_name, 'Ausschuss' AS type FROM supplier")
def council_organizations(t):
    obj = F.struct(F.col("s_suppkey").cast("string").alias("id"), F.lit("x/Organization").alias("type"), F.col("s_name").alias("name"), F.lit("Ausschuss").alias("organizationType"))
    o = C.council_objects(pages_of(t("supplier").select(obj.alias("o"), "s_suppkey"), F.floor(F.col("s_suppkey") / PER_PAGE)))
    return C.organizations(o).select("id", "name", "short_name", "type")


@query("council_next_links", "SELECT 'https://rat.example/liste?page=' || k AS url, 'https://rat.example/liste?page=2' AS next_url FROM (SELECT DISTINCT o_orderkey // 100 AS k FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))")
def council_next_links(t):
    return C.next_links(paper_pages(t))


def bodies(t):
    b = t("nation").select((F.col("n_regionkey")).cast("string").alias("system"), F.concat(F.lit("x/bodies/"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("N"), F.col("n_nationkey") % 2).alias("short_name"), F.col("n_nationkey").alias("pos"))
    c = t("customer").select(F.col("c_custkey").cast("string").alias("city"), (F.col("c_custkey") % 5).cast("string").alias("system"),
                             F.when(F.col("c_custkey") % 3 == 0, (F.col("c_nationkey")).cast("string")).alias("body_id"), F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("Nation-"), F.col("c_nationkey"))).otherwise("").alias("body_name"))
    return C.choose_body(b, c)


BODY = """SELECT CAST(c_custkey AS VARCHAR) AS city, min('x/bodies/' || n_nationkey) FILTER (ok) AS only_body, arg_min('x/bodies/' || n_nationkey, n_nationkey) FILTER (ok) AS first_body, count(*) FILTER (ok) AS n, any_value(c_custkey % 3) AS m FROM (
  SELECT c_custkey, n_nationkey, CASE c_custkey % 3 WHEN 0 THEN n_nationkey = c_nationkey WHEN 1 THEN contains('nation ' || n_nationkey || ' | n' || n_nationkey % 2, 'nation ' || c_nationkey) ELSE true END AS ok FROM customer JOIN nation ON n_regionkey = c_custkey % 5) GROUP BY c_custkey"""


@query("choose_body", f"SELECT city, first_body AS body FROM ({BODY}) WHERE n = 1 OR (n > 1 AND m <> 1)")
def choose_body(t):
    return bodies(t)[0]


@query("choose_body_rejects", f"SELECT city, n AS n_matches FROM ({BODY}) WHERE NOT (n = 1 OR (n > 1 AND m <> 1))")
def choose_body_rejects(t):
    return bodies(t)[1]


def plan_pages(t):
    """Orders as procedures, a few per page; some hidden, foreign or reversed."""
    k = F.col("o_orderkey")
    attr = F.struct(F.concat(F.lit("<b>Plan</b> "), k).alias("externalName"), F.lit("A &amp; B").alias("externalDescription"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("externalStartDate"),
                    F.date_format(F.date_add("o_orderdate", F.when(k % 997 == 0, -5).otherwise(20)), "yyyy-MM-dd").alias("externalEndDate"), F.when(k % 3 == 0, "x.y.participation").otherwise("x.y.neu").alias("externalPhaseTranslationKey"),
                    F.when(k % 4 == 0, "hidden").when(k % 4 == 1, "write").otherwise("").alias("externalPhasePermissionset"), F.when(k % 10 == 7, "Bonn").otherwise("Stadt Köln").alias("owningOrganisationName"))
    obj = F.struct(F.lit("Procedure").alias("type"), F.concat(F.lit("v"), k % 7000).alias("id"), attr.alias("attributes"))
    return (t("orders").select(obj.alias("o"), F.floor(k / 20).alias("page_no")).groupBy("page_no").agg(F.to_json(F.struct(F.array_sort(F.collect_list("o"), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("data"))).alias("body"))
            .select(F.lit("stadt:plan").alias("source_id"), F.concat(F.lit("https://plan.example/l?p="), "page_no").alias("url"), "page_no", "body"))


PLAN = """SELECT o_orderkey AS k, o_orderkey // 20 AS page_no, max(CASE WHEN o_orderkey % 997 = 0 AND o_orderkey % 4 <> 0 AND o_orderkey % 10 <> 7 THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderkey // 20) AS bad, o_orderdate FROM orders"""


@query("planning_procedures", f"""SELECT 'https://plan.example/v' || k % 7000 AS id, 'Plan ' || k AS title, CASE WHEN k % 3 = 0 THEN 'Beteiligung Öffentlichkeit' ELSE 'Verfahrensphase unbekannt' END AS phase, strftime(o_orderdate, '%Y-%m-%d') AS begin, 'A & B' AS description,
  CASE WHEN k % 4 = 1 THEN 'write' ELSE '' END AS permission FROM ({PLAN}) WHERE bad = 0 AND k % 4 <> 0 AND k % 10 <> 7 QUALIFY row_number() OVER (PARTITION BY k % 7000 ORDER BY page_no DESC) = 1""")
def planning_procedures(t):
    return planning.planning_procedures(plan_pages(t), "Stadt Köln", "https://plan.example/{id}")[0].select("id", "title", "phase", "begin", "description", "permission")


@query("planning_rejects", f"SELECT DISTINCT 'https://plan.example/l?p=' || page_no AS url, 'end of participation before its begin' AS error FROM ({PLAN}) WHERE bad = 1")
def planning_rejects(t):
    return planning.planning_procedures(plan_pages(t), "Stadt Köln", "https://plan.example/{id}")[1].select("url", "error")


@query("page_links", r"""SELECT page_id AS record_id, 'https://plan.example/file/' || page_id || '/' || h AS id, arg_max(n, i) AS name FROM (SELECT page_id, i, regexp_extract(a, 'href="/([^"]+)"', 1) AS h, regexp_replace(regexp_extract(a, '>([^<]*)</a>', 1), '\s+', ' ', 'g') AS n FROM
  (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]+">[^<]*</a>')) AS a, unnest(range(len(regexp_extract_all(html, '<a href="[^"]+">[^<]*</a>')))) AS i FROM pages)) WHERE NOT regexp_matches(h, '[?#/]') GROUP BY 1, 2""")
def page_links(t):
    """The pages as public detail pages: their links moved under the file path."""
    html = F.concat(F.lit('<div id="infolistContentMetaDescription"></div>'), F.replace("html", F.lit('<a href="/'), F.concat(F.lit('<a href="/file/'), F.col("page_id"), F.lit("/"))))
    p = t("pages").select(F.col("page_id").alias("record_id"), F.lit("https://plan.example/d").alias("url"), html.alias("html"))
    return planning.page_document_links(p)[0].select("record_id", "id", "name")


@query("detail_status", "SELECT page_id AS record_id, CASE page_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'login' ELSE 'unknown' END AS status FROM pages")
def detail_status(t):
    k = F.col("page_id") % 3
    extra = F.when(k == 0, '<p id="helpPublicDetailTimelimit">').when(k == 1, '<input type="Password">').otherwise("")
    return planning.page_document_links(t("pages").select(F.col("page_id").alias("record_id"), "url", F.concat(extra, F.col("html")).alias("html")))[1]


def notice_pages(t):
    """Orders as official notices on list pages of some fifty entries."""
    k = F.col("o_orderkey")
    a = F.concat(F.lit('<li><a class="x" href="/mediaasset/content/'), F.when(k % 9 == 0, "anderes").otherwise("bekanntmachungen"), F.lit("/"), F.lpad(k % 1000, 4, "0"), F.lit("-01_"), k, F.lit('.pdf">'),
                 F.when(k % 5 == 0, "").otherwise(F.concat(F.lit('<time datetime="'), F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00"), F.lit('">x</time>'))),
                 F.lit("<figure>Satzungsbeschluss &bdquo;"), F.col("o_orderpriority"), F.lit("&ldquo;<figcaption>PDF</figcaption></figure>"), F.when(k % 3 == 0, " Hinweisveröffentlichung 02.03.2026").otherwise(""), F.lit("</a></li>"))
    return (t("orders").select(F.floor(k / 50).alias("page_id"), a.alias("a")).groupBy("page_id").agg(F.concat(F.lit("<ul>"), F.array_join(F.collect_list("a"), ""), F.lit('</ul><a href="?page=3" rel="next">w</a> Treffer 1–50 von 191')).alias("html"))
            .select(F.lit("stadt:amtsblatt").alias("source_id"), "page_id", F.lit("https://stadt.example/liste").alias("url"), "html"))


@query("notice_entries", """SELECT 'bekanntmachung:' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 4, '0') || '-01_' || o_orderkey AS id, 'Satzungsbeschluss „' || o_orderpriority || '“' AS title, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 4, '0') || '-01' AS reference,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date, 'Satzungsbeschluss' AS step, CASE WHEN o_orderkey % 3 = 0 THEN 'Hinweisveröffentlichung 02.03.2026' ELSE '' END AS extra,
  'Bekanntmachung, Stadt Köln' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ', veröffentlicht am ' || strftime(o_orderdate, '%d.%m.%Y') END || '. Verfahrensschritt laut Quelle: Satzungsbeschluss.' || CASE WHEN o_orderkey % 3 = 0 THEN ' Hinweisveröffentlichung 02.03.2026.' ELSE '' END
  || ' Es gilt der verlinkte Text; erfasst sind Titel, Tag und Adresse.' AS status_text FROM orders WHERE o_orderkey % 9 <> 0""")
def notice_entries(t):
    return notices.notice_entries(notice_pages(t)).select("id", "title", "reference", "date", "step", "extra", "status_text")


def card_pages(t):
    k = F.col("p_partkey")
    card = F.concat(F.lit('<article class="n group--teaser x"><p class="participation-countdown z">'), F.when(k % 2 == 0, "Noch 3 Tage").otherwise("Beendet"), F.lit('</p><h3 class="title"><a href="'), F.when(k % 7 == 0, "/user/").otherwise("/projekt/"), k, F.lit('">'),
                    F.col("p_name"), F.lit('</a></h3><div class="field--field_description">'), F.repeat(F.concat(F.col("p_type"), F.lit(" ")), F.col("p_size") * 2), F.lit('</div><span class="countValue">'), F.col("p_size"), F.lit("</span> Ideen</article>"))
    return (t("part").select(F.floor(k / 40).alias("page_id"), card.alias("c")).groupBy("page_id").agg(F.array_join(F.collect_list("c"), "").alias("html"))
            .select(F.lit("stadt:beteiligung").alias("source_id"), "page_id", F.lit("https://mitreden.example/p").alias("url"), "html"))


@query("participation_entries", """SELECT 'beteiligung:projekt-' || p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'Beteiligung läuft' ELSE 'Beteiligung geschlossen' END AS short_status, p_partkey % 2 = 0 AS open,
  CASE WHEN length(s) > 600 THEN rtrim(left(s, 599)) || '…' ELSE s END AS short_text, p_size || ' Ideen laut Plattform' AS extra FROM (SELECT *, trim(repeat(p_type || ' ', p_size * 2)) AS s FROM part) WHERE p_partkey % 7 <> 0""")
def participation_entries(t):
    return notices.participation_entries(card_pages(t))[0].select("id", "title", "short_status", "open", "short_text", "extra")


@query("participation_rejects", "SELECT p_partkey // 40 AS page_id, count(*) FILTER (p_partkey % 7 = 0) AS rejected FROM part GROUP BY 1")
def participation_rejects(t):
    return notices.participation_entries(card_pages(t))[1].select("page_id", "rejected")


@query("next_page_audit", "SELECT page_id, 'https://stadt.example/l/' || page_id AS url, 'https://stadt.example/l/' || page_id + 1 AS next_url FROM pages WHERE page_id % 10 <> 0 AND (page_id % 10 = 9 OR page_id = (SELECT max(page_id) FROM pages))")
def next_page_audit(t):
    """Every tenth page is not stored; the pages before the gaps name a page that is missing."""
    at = F.lit("https://stadt.example/l/")
    html = F.concat(F.col("html"), F.lit('<a class="n" href="/l/'), F.col("page_id") + 1, F.lit('" rel="next">weiter</a>'))
    return notices.missing_pages(t("pages").filter("page_id % 10 <> 0").select("page_id", F.concat(at, "page_id").alias("url"), html.alias("html")))


@query("next_pages", "SELECT o_orderkey // 50 AS page_id, 'https://stadt.example/liste?page=3' AS next_url, 'Treffer 1–50 von 191' AS note FROM orders GROUP BY 1")
def next_pages(t):
    p = notice_pages(t)
    return notices.next_pages(p).join(notices.hit_notes(p), "page_id").select("page_id", "next_url", "note")


@query("list_years", "SELECT DISTINCT year(o_orderdate) AS year FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1999")
def list_years(t):
    lists = t("orders").select(F.lit("u").alias("url"), F.year("o_orderdate").alias("year")).distinct()
    return notices.select_list_years(lists, "1999-06-01", 1994).select(F.col("year").cast("long").alias("year"))


@query("split_entries", "SELECT 'beteiligung:projekt-' || p_partkey AS id, 'stadt:beteiligung' AS source_id, trim(regexp_replace(lower(p_name || ' beteiligungsangebot ' || 'buergerbeteiligung meinung fuer koeln ' || CASE WHEN length(s) > 600 THEN rtrim(left(s, 599)) ELSE s END), '[^0-9a-z]+', ' ', 'g')) AS search_text, '2026-10-12' AS seen FROM (SELECT *, trim(repeat(p_type || ' ', p_size * 2)) AS s FROM part) WHERE p_partkey % 7 <> 0")
def split_entries(t):
    rec, rows = notices.split_entries(notices.participation_entries(card_pages(t))[0], "2026-10-12")
    return rec.join(rows, "id").select("id", "source_id", "search_text", "seen")


@query("entry_documents", "SELECT 'beteiligung:projekt-' || p_partkey AS record_id, CAST(p_partkey AS VARCHAR) AS file_name, 'https://mitreden.example/projekt/' || p_partkey AS url, 'bekanntmachung' AS role FROM part WHERE p_partkey % 7 <> 0")
def entry_documents(t):
    return notices.document_refs(notices.participation_entries(card_pages(t))[0], F.col("title"), "bekanntmachung").select("record_id", "file_name", "url", "role")


def feed_pages(t):
    """Events as feed items of their user; each feed holds the items of one user and day."""
    k = F.col("event_id")
    session = F.concat(F.lit("Rat "), F.col("user_id"), F.lit(" | "), F.date_format("ts", "dd.MM.yyyy - HH:mm"), F.lit(" (Sitzung N/"), k, F.lit(")"))
    item = F.concat(F.lit("<item><title>"), F.when(k % 5 == 0, "Niederschrift").otherwise(session), F.lit("</title><link>https://rat.example/x?si"), k, F.lit("</link><description><![CDATA[Vorab <table><tr><td>Ort:</td><td>Saal &amp; "), F.col("event_type"), F.lit("</td></tr></table>]]></description></item>"))
    press = F.concat(F.lit("<item><title>Meldung "), k, F.lit("</title><link>"), F.when(k % 4 == 0, "http://rat.example/p").otherwise("https://rat.example/p"), k, F.lit("</link><guid>g"), k, F.lit("</guid><pubDate>"), F.date_format("ts", "E, dd MMM yyyy HH:mm:ss"), F.lit(" +0200</pubDate><description>&lt;p&gt;Text&lt;/p&gt;</description></item>"))
    kind = F.when(F.col("user_id") % 2 == 0, "sitzungen").otherwise("presse")
    e = t("events").select(F.col("user_id").cast("string").alias("source_id"), F.to_date("ts").alias("day"), kind.alias("kind"), F.when(F.col("user_id") % 2 == 0, item).otherwise(press).alias("i"))
    return (e.groupBy("source_id", "kind", "day").agg(F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>T</title>'), F.array_join(F.collect_list("i"), ""), F.lit("</channel></rss>")).alias("body"))
            .select("source_id", "kind", F.lit("https://rat.example/rss").alias("url"), "body"))


@query("session_hints", "SELECT CAST(user_id AS VARCHAR) AS source_id, 'sitzung:N/' || event_id AS id, 'Rat ' || user_id || ' – Sitzung N/' || event_id AS title, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M') AS time, 'Saal & ' || event_type AS place, 'Rat ' || user_id AS committee, 'Vorab' AS short_text, 'meetings/' || event_id AS refers_to FROM events WHERE user_id % 2 = 0 AND event_id % 5 <> 0")
def session_hints(t):
    rows = feeds.hints(feed_pages(t).filter("kind = 'sitzungen'"), "x")[0]
    return rows.select("source_id", "id", "title", "date", "time", "place", "committee", "short_text", "refers_to")


@query("press_hints", "SELECT CAST(user_id AS VARCHAR) AS source_id, 'g' || event_id AS id, 'Meldung ' || event_id AS title, strftime(ts, '%Y-%m-%d') AS date, 'Text' AS short_text FROM events WHERE user_id % 2 = 1 AND event_id % 4 <> 0")
def press_hints(t):
    return feeds.hints(feed_pages(t).filter("kind = 'presse'"), "x")[0].select("source_id", "id", "title", "date", "short_text")


@query("feed_rejects", "SELECT CAST(user_id AS VARCHAR) AS source_id, count(*) FILTER (CASE WHEN user_id % 2 = 0 THEN event_id % 5 <> 0 ELSE event_id % 4 <> 0 END) AS accepted, count(*) FILTER (CASE WHEN user_id % 2 = 0 THEN event_id % 5 = 0 ELSE event_id % 4 = 0 END) AS rejected FROM events GROUP BY 1")
def feed_rejects(t):
    return feeds.hints(feed_pages(t), "x")[1]


def catalogue_rows(t):
    """Suppliers as datasets with licences of several spellings and two distributions."""
    k = F.col("s_suppkey")
    licence = F.element_at(F.array(*[F.lit(x) for x in ("dl-de/by-2-0", "dl-zero-de/2.0", "CC BY 2.0", "Namensnennung", "", "CC0")]), (k % 6 + 1).cast("int"))
    data = F.struct(F.concat(F.lit("https://daten.example/"), k, F.when(k % 2 == 0, ".csv").otherwise(".pdf")).alias("downloadURL"), F.when(k % 5 == 0, "text/tab-separated-values").otherwise("x").alias("mediaType"), F.when(k % 6 == 4, "cc zero 2.0").alias("license"))
    d = F.struct(F.concat(F.lit("id"), k).alias("identifier"), F.col("s_name").alias("title"), licence.alias("license"), F.struct(F.concat(F.lit("Amt "), F.col("s_nationkey")).alias("name")).alias("publisher"),
                 F.array(F.struct(F.struct(F.lit("pdf").alias("format"), F.lit("http://daten.example/a.pdf").alias("downloadURL"), F.lit(None).cast("string").alias("mediaType"), F.lit(None).cast("string").alias("license")).alias("data")),
                         F.struct(F.struct(F.lit("").alias("format"), data["downloadURL"].alias("downloadURL"), data["mediaType"].alias("mediaType"), data["license"].alias("license")).alias("data"))).alias("distribution"))
    return t("supplier").select(F.concat(F.lit("s"), k % 4).alias("source_id"), k.alias("position"), F.to_json(d).alias("dataset"))


def catalogue(t):
    return opendata.datasets(catalogue_rows(t))


def all_wanted(t):
    """Every dataset asked for by its title."""
    k = F.col("s_suppkey")
    return t("supplier").select(F.concat(F.lit("s"), k % 4).alias("source_id"), k.alias("entry_no"), F.col("s_name").alias("entry"))


@query("classify_licence", """SELECT 'id' || s_suppkey AS dataset_id, CASE WHEN s_suppkey % 6 IN (0, 3) THEN 'by' WHEN s_suppkey % 6 IN (1, 4, 5) THEN 'zero' END AS licence_kind, CASE WHEN s_suppkey % 6 IN (0, 3) THEN 'Datenlizenz Deutschland – Namensnennung – Version 2.0 (Namensnennung: Amt ' || s_nationkey || ')'
  WHEN s_suppkey % 6 IN (1, 4, 5) THEN 'Datenlizenz Deutschland – Zero – Version 2.0' ELSE '' END AS licence_text FROM supplier""")
def classify_licence(t):
    return opendata.classify_licence(catalogue(t)).select("dataset_id", "licence_kind", "licence_text")


@query("tabular_distributions", "SELECT 'id' || s_suppkey AS dataset_id, 1 AS index, 'https://daten.example/' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.csv' ELSE '.pdf' END AS original_url FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 5 = 0")
def tabular_distributions(t):
    tab = opendata.tabular_distributions(catalogue(t))
    return tab.join(opendata.original_urls(tab), "dataset_id").select("dataset_id", "index", "original_url")


WANT = "SELECT 's' || s_suppkey % 4 AS source_id, s_suppkey AS entry_no, CASE s_suppkey % 3 WHEN 0 THEN lower(s_name) WHEN 1 THEN 'Supplier im Stadtgebiet' ELSE 'Nichts da' END AS entry, s_suppkey % 3 AS m FROM supplier"


def wanted(t):
    k = F.col("s_suppkey")
    return t("supplier").select(F.concat(F.lit("s"), k % 4).alias("source_id"), k.alias("entry_no"), F.when(k % 3 == 0, F.lower("s_name")).when(k % 3 == 1, "Supplier im Stadtgebiet").otherwise("Nichts da").alias("entry"))


@query("select_datasets", f"""SELECT source_id, dataset_id, CAST(min(entry_no) AS BIGINT) AS entry_no FROM (SELECT w.source_id, w.entry_no, CASE WHEN m = 0 THEN 'id' || w.entry_no ELSE 'id' || (SELECT min(s_suppkey) FROM supplier WHERE 's' || s_suppkey % 4 = w.source_id) END AS dataset_id FROM ({WANT}) w WHERE m < 2) GROUP BY 1, 2""")
def select_datasets(t):
    return opendata.select_datasets(catalogue(t), wanted(t))[0].select("source_id", "dataset_id", "entry_no")


@query("dataset_counters", f"SELECT source_id, count(*) AS looked_up, count(*) FILTER (m = 1) AS fuzzy, count(*) FILTER (m = 2) AS not_found FROM ({WANT}) GROUP BY 1")
def dataset_counters(t):
    return opendata.select_datasets(catalogue(t), wanted(t))[1]


def answers(t):
    """Line items as table rows of their supplier's dataset, two answers each; every other answer as value lists."""
    k = F.col("l_suppkey")
    li = t("lineitem").withColumn("id", F.concat_ws(" ", "l_orderkey", "l_linenumber", "l_partkey"))
    fields = [F.when(F.col("l_linenumber") % 7 == 0, F.lit(None)).otherwise(F.col("id")).alias("nr"), F.concat(F.lit("Maßnahme "), F.col("l_partkey")).alias("Maßnahme"), F.date_format("l_shipdate", "d.M.yyyy").alias("beginn_datum"),
              F.date_format(F.date_add("l_shipdate", 9), "yyyy-MM-dd").alias("ende"), F.col("l_returnflag").alias("amt"), (F.col("l_linestatus") == "O").cast("string").alias("aktiv")]
    o = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    page = F.pmod(F.xxhash64("id"), F.lit(2))
    g = li.select(k.alias("s"), page.alias("page_no"), o.alias("o")).groupBy("s", "page_no").agg(F.array_join(F.array_sort(F.collect_list("o")), ",").alias("rows"), F.count(F.lit(1)).alias("n"))
    return g.select(F.concat(F.lit("id"), "s").alias("dataset_id"), F.lit(1).alias("index"), "page_no", F.concat(F.lit('{"count":'), "n", F.lit(',"results":['), "rows", F.lit("]}")).alias("body"))


def _field(name, value):
    return f"'{len(name)}:{name}' || length({value}) || ':' || {value}"


ROWKEY = ("CASE WHEN l_linenumber % 7 <> 0 THEN l_orderkey || '-' || l_linenumber || '-' || l_partkey ELSE 'z' || sha256("
          + " || ".join(_field(n, v) for n, v in (
              ("Maßnahme", "('Maßnahme ' || l_partkey)"), ("aktiv", "(CASE WHEN l_linestatus = 'O' THEN 'ja' ELSE 'nein' END)"), ("amt", "l_returnflag"),
              ("beginn_datum", "(day(l_shipdate) || '.' || month(l_shipdate) || '.' || year(l_shipdate))"), ("ende", "strftime(l_shipdate + INTERVAL 9 DAY, '%Y-%m-%d')"), ("nr", "''")))
          + ") END")


def entries(t):
    meta = opendata.classify_licence(catalogue(t)).select("dataset_id", "title", "modified", "licence_text").withColumn("original_url", F.lit("https://daten.example/"))
    given = answers(t)
    shapes = opendata.row_shapes(given)
    return opendata.dataset_rows_to_entries(opendata.open_data_rows(given, shapes), meta, "2000-01-01", names=opendata.row_names(shapes))


@query("open_data_rows", "SELECT 'id' || l_suppkey AS dataset_id, count(*) AS n, CAST(max(rn) AS BIGINT) AS highest FROM (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey) AS rn FROM lineitem) GROUP BY 1")
def open_data_rows(t):
    return opendata.open_data_rows(answers(t)).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), F.max("number").alias("highest"))


@query("stable_row_key", f"SELECT 'opendata:id' || l_suppkey || ':' || {ROWKEY} AS id, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY 1")
def stable_row_key(t):
    return entries(t).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("dataset_entries", f"""SELECT 'opendata:id' || l_suppkey || ':' || {ROWKEY} AS id, 'Maßnahme ' || l_partkey AS title, CASE WHEN l_linenumber % 7 <> 0 THEN l_orderkey || ' ' || l_linenumber || ' ' || l_partkey ELSE '' END AS reference, strftime(l_shipdate, '%Y-%m-%d') AS date,
  strftime(l_shipdate + INTERVAL 9 DAY, '%Y-%m-%d') AS deadline, l_shipdate + INTERVAL 9 DAY >= TIMESTAMP '2000-01-01' AS open, 'beginn datum: ' || day(l_shipdate) || '.' || month(l_shipdate) || '.' || year(l_shipdate) || ' · ende: ' || strftime(l_shipdate + INTERVAL 9 DAY, '%Y-%m-%d') || ' · amt: ' || l_returnflag
  || ' · aktiv: ' || CASE WHEN l_linestatus = 'O' THEN 'ja' ELSE 'nein' END AS short_text FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier)""")
def dataset_entries(t):
    return entries(t).select("id", "title", "reference", "date", "deadline", "open", "short_text")


@query("column_roles", """SELECT w AS name, w IN ('titel','title','name','bezeichnung','massnahme','massnahmen','vorhaben','objekt','kurztext','beschreibung','zweck','art','strasse','strassenname','adresse','standort','ort','lage') AS is_title, w IN ('datum','date','beginn','von','start','veroeffentlicht','bekanntmachung','aufstellungsbeschluss','erstellt') AS is_date FROM
  (SELECT DISTINCT lower(unnest(string_split(p_type || ' von ' || p_brand || ' Name ' || p_name, ' '))) AS w FROM part)""")
def column_roles(t):
    names = t("part").select(F.explode(F.split(F.concat_ws(" ", "p_type", F.lit("von"), "p_brand", F.lit("Name"), "p_name"), " ")).alias("w")).select(F.lower("w").alias("name")).distinct()
    return opendata.column_roles(names).select("name", "is_title", "is_date")


@query("load_press", with_ctes("bench_words", body="SELECT item_id AS pos, CASE WHEN item_id % 5 = 0 THEN 'medium, title and url are needed' WHEN item_id % 5 = 1 THEN 'url is not http(s)' WHEN item_id % 5 = 2 THEN 'date is not an ISO day' ELSE 'ok' END AS verdict FROM benchmark"))
def load_press(t):
    i = F.col("item_id") % 5
    refs = t("benchmark").select(F.lit(B.CITY).alias("city"), F.col("item_id").alias("pos"), F.when(i == 0, "").otherwise("M").alias("medium"), F.lit("T").alias("title"), F.when(i == 1, "ftp://x").otherwise("https://x").alias("url"),
                                 F.when(i == 2, "2026-02-31").otherwise("2026-01-02").alias("date"), F.split("text", " ").alias("keywords"), F.array().cast("array<string>").alias("references"))
    good, bad = registers.load_press(refs)
    return good.select("pos", F.lit("ok").alias("verdict")).unionByName(bad.select("pos", F.col("error").alias("verdict")))
