"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from townledger.functions import dates, rules, text, urls
from townledger.functions.html import html_to_text
from townledger.functions.registry import register_functions

from .base import query, s_date_de, s_norm, s_result, s_stem, s_street, s_tokens, s_variants

NT = s_norm("text")


@query("norm_documents", f"SELECT doc_id, {NT} AS n FROM documents")
def norm_documents(t):
    return t("documents").select("doc_id", text.norm("text").alias("n"))


@query("street_key_documents", f"SELECT doc_id, CASE WHEN n = '' THEN '' ELSE {s_street('n')} END AS k FROM "
       f"(SELECT doc_id, {s_norm('''replace(text, 'st', 'str.')''')} AS n FROM documents)")
def street_key_documents(t):
    """Abbreviations occur because the texts are rewritten to hold some."""
    return t("documents").select("doc_id", text.street_key(F.replace("text", F.lit("st"), F.lit("str."))).alias("k"))


@query("stem_tokens", f"SELECT w, {s_stem('w')} AS s, count(*) AS n FROM (SELECT unnest({s_tokens(NT)}) AS w FROM documents) GROUP BY 1, 2")
def stem_tokens(t):
    words = t("documents").select(F.explode(text.tokens(text.norm("text"))).alias("w"))
    return words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).select("w", text.stem("w").alias("s"), "n")


@query("term_variants", f"SELECT w, array_to_string({s_variants('w')}, '|') AS v FROM (SELECT DISTINCT unnest({s_tokens(s_norm('''replace(text, 'e ', 'estraße ')'''))}) AS w FROM conversations)")
def term_variants(t):
    words = t("conversations").select(F.explode(text.tokens(text.norm(F.replace("text", F.lit("e "), F.lit("estraße "))))).alias("w")).distinct()
    return words.select("w", F.array_join(text.term_variants("w"), "|").alias("v"))


@query("short_id_pages", "SELECT page_id, regexp_extract(rtrim(url, '/'), '([^/]*)$', 1) AS s FROM pages")
def short_id_pages(t):
    return t("pages").select("page_id", text.short_id("url").alias("s"))


ISO = "strftime(o_orderdate, '%Y-%m-%d')"


@query("date_format_de", f"SELECT o_orderkey, {s_date_de('d')} AS d FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%Y%m%d99') "
       f"WHEN o_orderkey % 11 = 0 THEN NULL ELSE {ISO} || 'T10:00' END AS d0, coalesce(d0, '') AS d FROM orders)")
def date_format_de(t):
    d = F.when(F.col("o_orderkey") % 7 == 0, F.date_format("o_orderdate", "yyyyMMdd'99'")).when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd'T10:00'"))
    return t("orders").select("o_orderkey", dates.date_de(d).alias("d"))


@query("parse_dates", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN strftime(l_shipdate, '%Y-%m-%d')
  WHEN l_linenumber % 3 = 1 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE '' END AS d FROM lineitem""")
def parse_dates(t):
    """ISO stamps, German dates inside a sentence, and text without any date."""
    m = F.col("l_linenumber") % 3
    raw = (F.when(m == 0, F.date_format("l_shipdate", "' 'yyyy-MM-dd'T08:00:00Z'"))
           .when(m == 1, F.concat(F.lit("bis zum "), F.date_format("l_shipdate", "d.M.yyyy"), F.lit(" um 12.15")))
           .otherwise(F.date_format("l_shipdate", "'Termin 'd.M.yyyy'9'")))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", dates.parse_date(raw).alias("d"))


EV = "SELECT event_id, ts, event_id % 5 AS m FROM events"
BER = "timezone('Europe/Berlin', timezone('UTC', ts))"  # Berlin wall clock of a UTC instant


@query("moments", f"""SELECT event_id, CASE m WHEN 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S')
  WHEN 1 THEN strftime(timezone('UTC', timezone('Europe/Berlin', date_trunc('second', ts))), '%Y-%m-%d %H:%M:%S')
  WHEN 2 THEN strftime(timezone('UTC', timezone('Europe/Berlin', CAST(ts AS DATE) + INTERVAL 86399 SECOND)), '%Y-%m-%d %H:%M:%S')
  WHEN 3 THEN NULL ELSE strftime(date_trunc('second', ts) - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') END AS at FROM ({EV})""")
def moments(t):
    """UTC stamps, naive Berlin stamps, date-only ends, broken text, stamps with an offset."""
    m = F.col("event_id") % 5
    raw = (F.when(m == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(m == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
           .when(m == 2, F.date_format("ts", "yyyy-MM-dd")).when(m == 3, F.date_format("ts", "dd.MM.yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+05:00'")))
    return t("events").select("event_id", F.date_format(dates.moment(raw, end=True), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("moments_de", f"SELECT event_id, CASE WHEN m < 3 THEN strftime({BER}, '%d.%m.%Y, %H:%M') || ' Uhr' ELSE strftime(ts, '%d.%m.%Y') END AS d, strftime({BER}, '%Y-%m-%d') AS day FROM ({EV})")
def moments_de(t):
    raw = F.when(F.col("event_id") % 5 < 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    full = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t("events").select("event_id", dates.moment_de(raw).alias("d"), dates.local_day(dates.moment(full)).alias("day"))


@query("since_dates", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN strftime(DATE '2026-10-12' - CAST(p_size AS INTEGER), '%Y-%m-%d') WHEN p_partkey % 3 = 1 THEN '2020-01-01' END AS s FROM part")
def since_dates(t):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit("d"))).when(F.col("p_partkey") % 3 == 1, "2020-01-01").otherwise(" ")
    return t("part").select("p_partkey", dates.since(raw, "2026-10-12").alias("s"))


# Result texts given to the rows by their number.
RESULTS = ("Übergang zum nächsten TOP, beschlossen", "mehrheitlich abgelehnt", "ungeändert beschlossen", "einstimmig angenommen", "zur Kenntnis genommen",
           "durch Verwaltungshandeln erledigt", "Zurückgezogen", "in den Ausschuss verwiesen", "zurückgestellt", "VERTAGT", "siehe Niederschrift", "", "–")
S_RESULT_TEXT = "list_extract([" + ", ".join(f"'{r}'" for r in RESULTS) + f"], CAST((l_orderkey + l_linenumber) % {len(RESULTS)} + 1 AS INTEGER))"


def result_text():
    return F.get(F.array(*[F.lit(r) for r in RESULTS]), ((F.col("l_orderkey") + F.col("l_linenumber")) % len(RESULTS)).cast("int"))


@query("result_category", f"SELECT c, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM (SELECT l_linenumber, {s_result('r')} AS c FROM (SELECT *, {s_norm(S_RESULT_TEXT)} AS r FROM lineitem)) GROUP BY c")
def result_category(t):
    df = t("lineitem").select("l_linenumber", rules.result_category(result_text()).alias("c"))
    return df.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


# Notice titles given to the rows by their number.
TITLES = ("Öffentliche Bekanntmachung von Bauleitplänen: frühzeitige Beteiligung der Öffentlichkeit", "Beteiligung der Öffentlichkeit", "Widmung des Platzes",
          "Öffentliche Bekanntmachung von Bauleitplänen – Satzungsbeschluss", "Veröffentlichung eines Bebauungsplan-Entwurfs", "Sonstige Mitteilung",
          "Unterrichtung der Öffentlichkeit", "Inkrafttreten eines Bebauungsplans", "Aufstellungsbeschluss und Widmung", "Veröffentlichung eines Flächennutzungsplan-Entwurfs")
STEPS = ("Frühzeitige Beteiligung der Öffentlichkeit", "Beteiligung der Öffentlichkeit", "Widmung einer Straße", "Satzungsbeschluss", "Veröffentlichung eines B-Plan-Entwurfs", "",
         "Unterrichtung der Öffentlichkeit", "Inkrafttreten eines Bebauungsplans", "Aufstellungsbeschluss", "Veröffentlichung eines FNP-Entwurfs")


@query("notice_rules", "SELECT o_orderkey, list_extract([" + ", ".join(f"'{s}'" for s in STEPS) + "], CAST(o_orderkey % 10 + 1 AS INTEGER)) AS step, "
       "CASE WHEN o_orderkey % 10 IN (0, 3) THEN 'Öffentliche Bekanntmachung von Bauleitplänen' ELSE '' END AS category FROM orders")
def notice_rules(t):
    title = F.get(F.array(*[F.lit(x) for x in TITLES]), (F.col("o_orderkey") % 10).cast("int"))
    return t("orders").select("o_orderkey", rules.procedure_step(title).alias("step"), rules.notice_category(title).alias("category"))


LINES = ("", "Die Beteiligung ist beendet", "Startet in 3 Tagen", "vom 1. bis 3. Mai", "Läuft noch 5 Tage", "Noch offen", "Kein Hinweis", "ab dem 2. Juni")
LINE_RESULT = (("ohne Statusangabe", 0), ("Beteiligung geschlossen", 0), ("Beteiligung angekündigt", 1), ("Beteiligung angekündigt", 1), ("Beteiligung läuft", 1),
               ("Beteiligung läuft", 1), ("Kein Hinweis", 0), ("Beteiligung angekündigt", 1))


@query("status_line", "SELECT event_id, list_extract([" + ", ".join(f"'{a}'" for a, _ in LINE_RESULT) + "], CAST(event_id % 8 + 1 AS INTEGER)) AS short, "
       "list_extract([" + ", ".join(str(b) for _, b in LINE_RESULT) + "], CAST(event_id % 8 + 1 AS INTEGER)) AS is_open FROM events")
def status_line(t):
    line = F.get(F.array(*[F.lit(x) for x in LINES]), (F.col("event_id") % 8).cast("int"))
    s = rules.participation_status(line)
    return t("events").select("event_id", s["short"].alias("short"), s["open"].cast("int").alias("is_open"))


@query("truncate_texts", r"""SELECT doc_id, CASE WHEN length(s) > 600 THEN rtrim(left(s, 599)) || '…' ELSE s END AS s FROM
  (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)""")
def truncate_texts(t):
    return t("documents").select("doc_id", text.truncate_text("text").alias("s"))


@query("city_hyphen", "SELECT c_custkey, replace(replace('Neubau in Köln - ' || c_name || ', Köln-Süd, Altköln-Nord', 'Köln - ', 'Köln '), 'Köln-S', 'Köln S') AS s FROM customer")
def city_hyphen(t):
    raw = F.concat(F.lit("Neubau in Köln - "), F.col("c_name"), F.lit(", Köln-Süd, Altköln-Nord"))
    return t("customer").select("c_custkey", text.strip_city_hyphen(raw).alias("s"))


@query("record_summary", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Ohne Betreff' ELSE '„' || o_orderstatus || '“' END || ' (' || o_orderpriority || ', Nr. ' || o_custkey || ', vom '
  || strftime(o_orderdate, '%d.%m.%Y') || ').' || CASE WHEN o_orderkey % 3 = 0 THEN ' Ortsbezug: Mitte, Nord.' ELSE '' END || ' Text.'
  || CASE WHEN o_orderkey % 4 > 0 THEN ' ' || (o_orderkey % 4) || ' verlinkte(s) Dokument(e).' ELSE '' END AS s FROM orders""")
def record_summary(t):
    k = F.col("o_orderkey")
    title = F.when(k % 5 == 0, "").otherwise(F.col("o_orderstatus"))
    places = F.when(k % 3 == 0, F.array(F.lit("Mitte"), F.lit("Nord"))).otherwise(F.array().cast("array<string>"))
    s = rules.record_summary(title, F.col("o_orderpriority"), F.col("o_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("Text"), places, k % 4)
    return t("orders").select("o_orderkey", s.alias("s"))


@query("entry_summaries", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '„A“ B.' ELSE '„' || o_orderpriority || '“.' END || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' kurz' END
  || ' Stand.' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ' 3 Beiträge.' END AS s,
  '„' || o_orderpriority || '“. Erster Satz. Zweiter. Stand.' AS p FROM orders""")
def entry_summaries(t):
    k = F.col("o_orderkey")
    s = rules.entry_summary(F.when(k % 2 == 0, "„A“ B").otherwise(F.col("o_orderpriority")), F.when(k % 3 == 0, "").otherwise("kurz"), F.lit("Stand."), F.when(k % 5 == 0, "").otherwise("3 Beiträge"))
    return t("orders").select("o_orderkey", s.alias("s"), rules.plan_summary("o_orderpriority", F.lit("Erster Satz. Zweiter."), F.lit("Stand")).alias("p"))


@query("sentence_extracts")
def sentence_extracts(t):
    """Sentence choice needs look-behind in SQL; tested against small cases."""
    return t("documents").select("doc_id", rules.extract_sentences("text").alias("s"))


@query("search_texts", f"SELECT doc_id, {s_norm('''lang || ' ' || source || ' ' || text''')} AS s FROM documents")
def search_texts(t):
    return t("documents").select("doc_id", text.search_text("lang", F.lit(""), "source", F.lit(None), "text").alias("s"))


@query("label_lookups", """SELECT event_type, k, CASE k WHEN 0 THEN 'Datenzeilen neu übernommen' WHEN 1 THEN upper(event_type[1]) || event_type[2:] || ' neu geladen' ELSE upper(event_type[1]) || event_type[2:] END AS counter,
  CASE k WHEN 0 THEN 'Vorlage' WHEN 1 THEN 'Dokument' ELSE 'Planungsdokument' END AS role, n, n || CASE WHEN n = 1 THEN ' Vorgang' ELSE ' Vorgänge' END AS unit
  FROM (SELECT event_type, event_id % 3 AS k, count(*) AS n FROM events GROUP BY 1, 2)""")
def label_lookups(t):
    df = t("events").groupBy("event_type", (F.col("event_id") % 3).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    key = F.when(F.col("k") == 0, "opendata:neu").when(F.col("k") == 1, F.concat("event_type", F.lit(":neu_geladen"))).otherwise(F.col("event_type"))
    role = F.when(F.col("k") == 0, "vorlage").when(F.col("k") == 1, "x").otherwise("plandokument")
    return df.select("event_type", "k", rules.counter_label(key).alias("counter"), rules.role_label(role).alias("role"), "n", rules.with_unit("n", "Vorgang", "Vorgänge").alias("unit"))


@query("source_links", """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url WHEN page_id % 4 = 3 THEN NULL ELSE 'https://rat.example/vo?id=' || regexp_extract(rtrim(url, '/'), '([^/]*)$', 1) END AS link,
  'stadt:' || page_id AS source_id FROM pages""")
def source_links(t):
    """Own address first, else the template of the source (a sample borrows its base source's)."""
    from townledger.plans.answer import source_templates, with_links
    src = t("pages").sparkSession.createDataFrame([("stadt:ris", "stadt", "oparl", False, "https://rat.example/vo?id={id}"), ("stadt:leer", "stadt", "rss", False, "")],
                                                  "id string, city string, type string, sample boolean, web_record string")
    k = F.col("page_id") % 4
    recs = t("pages").select("page_id", F.col("url").alias("id"), F.when(k == 0, F.col("url")).otherwise("").alias("web"),
                             F.when(k == 1, "stadt:ris-demo").when(k == 2, "stadt:demo").when(k == 3, "stadt:leer").otherwise("stadt:ris").alias("source_id"))
    out = with_links(recs, source_templates(src))
    return out.select("page_id", "link", rules.source_id(F.lit("stadt"), F.col("page_id").cast("string")).alias("source_id"))


@query("sql_functions", f"SELECT doc_id, {NT} AS n, {s_stem('lang')} AS st FROM documents")
def sql_functions(t):
    docs = t("documents")
    register_functions(docs.sparkSession)
    return docs.selectExpr("doc_id", "town_norm(text) AS n", "town_stem(lang) AS st")


HTML_SQL = ("trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, "
            "'(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), "
            "'&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))")


@query("page_text", f"SELECT page_id, {HTML_SQL} AS s FROM pages")
def page_text(t):
    return t("pages").select("page_id", html_to_text("html").alias("s"))


@query("link_scope", r"""SELECT page_id, pos, CASE WHEN NOT starts_with(url, 'https:') THEN '' ELSE regexp_extract(url, '^(https://[^/?#]*)', 1) || h END AS link FROM
  (SELECT page_id, url, regexp_extract(a, 'href="([^"]+)"', 1) AS h, i AS pos FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="[^"]+">')) AS a, unnest(range(len(regexp_extract_all(html, '<a href="[^"]+">')))) AS i FROM pages))""")
def link_scope(t):
    from townledger.sources.notices import anchors
    a = anchors(t("pages"))
    return a.select("page_id", F.col("pos").cast("long").alias("pos"), urls.link_scope(F.col("href"), F.col("url")).alias("link"))
