import json

from pyspark.sql import functions as F

from townledger.operators.dims import CityDims  # noqa: F401
from townledger.sources import council as C
from townledger.sources import feeds, notices, opendata, planning, registers


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_council(spark, tmp_path):
    paper = {"id": "p1", "type": "https://schema/Paper", "name": "Radweg", "reference": "1/26", "date": "2026-01-01", "paperType": "Antrag",
             "consultation": ["c0", {"id": "c1", "meeting": "m1", "agendaItem": "a1", "organization": ["o1"], "authoritative": True}],
             "mainFile": {"id": "f1", "name": "V", "accessUrl": "u"}, "auxiliaryFile": [{"id": "f1", "name": "x"}, {"id": "f2", "fileName": "Protokoll.pdf", "downloadUrl": "d"}],
             "relatedPaper": "p2", "superordinatedPaper": [{"id": "p3"}, "p4"], "location": {"postalCode": "50667", "subLocality": "Niehl"}}
    meeting = {"id": "m1", "type": "x/Meeting", "name": "Rat", "start": "2026-02-03T10:00", "cancelled": True, "organization": "o1",
               "location": {"room": "R1", "postalCode": "50667", "locality": "Köln"}, "invitation": {"id": "f9", "name": "Einladung"},
               "agendaItem": [{"id": "a1", "number": "1", "order": 3, "name": "N", "result": "beschlossen", "public": False, "consultation": {"id": "c1"}}, "a9", {"name": "ohne id"}]}
    gone = {"id": "p9", "type": "x/Paper", "deleted": True}
    (tmp_path / "a.json").write_text(json.dumps({"data": [paper, gone, 5], "links": {"next": "?page=2"}}))
    (tmp_path / "b.json").write_text(json.dumps([meeting]))
    (tmp_path / "c.json").write_text(json.dumps({"id": "o1", "type": "x/Organization", "name": "Rat der Stadt", "shortName": None}))
    objs = C.read_council_objects(spark, str(tmp_path)).withColumn("source_id", F.lit("s")).withColumn("city", F.lit("k"))
    assert rows(objs, "type") == [("Meeting",), ("Organization",), ("Paper",), ("Paper",)]
    assert rows(C.papers(objs), "id", "title", "search_text") == [("p1", "Radweg", "radweg 1 26 antrag")]
    assert rows(C.deleted_ids(objs, "Paper")) == [("p9",)]
    m = C.meetings(objs).first()
    assert (m.date, m.place, m.cancelled, m.committee_ids) == ("2026-02-03", "R1, 50667 Köln", True, ["o1"])
    a = C.agenda_items(objs).collect()
    assert len(a) == 1 and (a[0].item_order, a[0].public, a[0].consultation_id) == (3, False, "c1")
    assert rows(C.consultations(objs), "id", "meeting_id", "agenda_item_id", "committee_ids", "authoritative") == [
        ("c0", "", "", [], False), ("c1", "m1", "a1", ["o1"], True)]
    assert rows(C.paper_relations(objs)) == [("p1", "p2", "verwandt"), ("p1", "p3", "uebergeordnet"), ("p1", "p4", "uebergeordnet")]
    assert rows(C.paper_locations(objs), "type", "value") == [("plz", "50667"), ("stadtteil_name", "Niehl")]
    assert rows(C.file_refs(objs), "id", "record_id", "meeting_id", "name", "role", "url") == [
        ("f1", "p1", "", "V", "vorlage", "u"), ("f2", "p1", "", "Protokoll.pdf", "protokoll", "d"), ("f9", "", "m1", "Einladung", "einladung", "")]
    assert rows(C.organizations(objs), "name", "short_name") == [("Rat der Stadt", "")]
    pages = spark.createDataFrame([("https://h/l?page=1", json.dumps({"data": [], "links": {"next": "?page=2"}}))], "url string, body string")
    assert C.next_links(pages).first().next_url == "https://h/l?page=2"


def test_choose_body(spark):
    bodies = spark.createDataFrame([("s", "x/bodies/1", "Stadt Neuss", "NE", 0), ("s", "x/bodies/2", "Kreis Neuss", "", 1), ("t", "y/1", "A", "", 0)],
                                   "system string, id string, name string, short_name string, pos int")
    cities = spark.createDataFrame([("neuss", "s", None, "Stadt Neuss"), ("kreis", "s", "2", ""), ("doppelt", "s", None, "Neuss"), ("fehlt", "s", None, "Bonn"), ("erste", "t", None, "")],
                                   "city string, system string, body_id string, body_name string")
    good, bad = C.choose_body(bodies, cities)
    assert rows(good) == [("erste", "y/1"), ("kreis", "x/bodies/2"), ("neuss", "x/bodies/1")]
    assert rows(bad) == [("doppelt", 2), ("fehlt", 0)]


def proc(i, **a):
    base = {"externalName": f"Plan {i}", "externalDescription": "<p>Text &amp; mehr</p>", "externalPhasePermissionset": "write",
            "owningOrganisationName": "Stadt Köln", "externalPhaseTranslationKey": "a.b.participation", "externalStartDate": "2026-01-01", "externalEndDate": "2026-02-01"}
    return {"type": "Procedure", "id": i, "attributes": {**base, **a}}


def test_planning(spark):
    pages = [("p1", [proc("a"), proc("b", externalPhasePermissionset="hidden"), proc("c", owningOrganisationName="Bonn"), proc("d", externalStartDate="1970-01-01")]),
             ("p2", [proc("e", externalEndDate="2025-01-01")]), ("p3", [proc("!bad")]), ("p4", [proc("f", externalName="")]), ("p5", None), ("p6", [{"type": "X"}])]
    data = [("s", u, i, json.dumps({"data": d, "links": {"next": {"href": "?page=2"}}} if d is not None else {"x": 1})) for i, (u, d) in enumerate(pages)]
    data.append(("s", "p7", 9, "no json"))
    df = spark.createDataFrame(data, "source_id string, url string, page_no int, body string")
    good, bad = planning.planning_procedures(df, "Stadt Koeln", "https://x.de/{id}")
    good, bad = planning.planning_procedures(df, "Stadt Köln", "https://x.de/{id}")
    assert rows(good, "id", "title", "phase", "begin", "description") == [
        ("https://x.de/a", "Plan a", "Beteiligung Öffentlichkeit", "2026-01-01", "Text & mehr"),
        ("https://x.de/d", "Plan d", "Beteiligung Öffentlichkeit", "", "Text & mehr")]
    assert [r[0] for r in rows(bad, "url")] == ["p2", "p3", "p4", "p5", "p6", "p7"]
    html = ('<div id="infolistContentMetaDescription"><a href="/file/a/1">Herunterladen Begründung (PDF, 2 MB)</a><a href="/file/a/1" title=""></a>'
            '<a href="/file/a/2" title="Plan"></a><a href="https://o.de/file/a/3">x</a><a href="/file/a/4?x=1">y</a></div>')
    detail = spark.createDataFrame([("r1", "https://h.de/d", html), ("r2", "https://h.de/e", '<input type="password">'), ("r3", "https://h.de/f", "")], "record_id string, url string, html string")
    docs, status = planning.page_document_links(detail)
    assert rows(docs, "id", "name", "mime") == [("https://h.de/file/a/1", "Begründung", "application/pdf"), ("https://h.de/file/a/2", "Plan", "")]
    assert rows(status) == [("r1", "ok"), ("r2", "login"), ("r3", "unknown")]


def test_plan_pages_are_worked_out_once(spark):
    """The filter on a page's errors stays above the work on its rows, which the plan holds once."""
    pages = spark.createDataFrame([("s", "p", 1, "{}")], "source_id string, url string, page_no int, body string")
    plan = planning.planning_procedures(pages, "Stadt Köln", "https://x.de/{id}")[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unexpected procedure object") == 1


def test_notices_and_participation(spark):
    html = ('<li><a class="k" href="/mediaasset/content/bekanntmachungen/2026/0191-01_plan.pdf"><time datetime="2026-10-01T00:00">1.10.</time>'
            '<figure>Öffentliche Bekanntmachung von Bauleitplänen: Satzungsbeschluss <b>A</b><figcaption>PDF</figcaption></figure> Hinweisveröffentlichung 02.10.2026</a></li>'
            '<a href="https://fremd.de/mediaasset/content/bekanntmachungen/x.pdf">fremd</a><a rel="next" href="?page=2#top">weiter</a> Treffer 1–15 von 191')
    pages = spark.createDataFrame([(1, "https://stadt.de/liste", html), (2, "https://stadt.de/liste?page=3", '<a href="?page=4">4</a><a href="?page=2">2</a>')], "page_id int, url string, html string")
    e = notices.notice_entries(pages).collect()
    assert len(e) == 1 and e[0].id == "bekanntmachung:0191-01_plan" and e[0].reference == "0191-01" and e[0].date == "2026-10-01"
    assert e[0].title == "Öffentliche Bekanntmachung von Bauleitplänen: Satzungsbeschluss A" and e[0].step == "Satzungsbeschluss"
    assert e[0].extra == "Hinweisveröffentlichung 02.10.2026" and e[0].category != ""
    assert rows(notices.next_pages(pages), "page_id", "next_url") == [(1, "https://stadt.de/liste?page=2"), (2, "https://stadt.de/liste?page=4")]
    assert rows(notices.hit_notes(pages), "note") == [("",), ("Treffer 1–15 von 191",)]
    assert notices.missing_pages(pages).count() == 2
    card = ('<article class="x group--teaser y"><p class="participation-countdown a">Noch 3 Tage</p><h3 class="title"><a href="/projekt/park">Park <i>neu</i></a></h3>'
            '<div class="field--field_description z"><p>Text</p></div><span class="countValue">7</span> Ideen</article>')
    bad = '<article class="group--teaser"><h3 class="title"><a href="/user/1">U</a></h3></article><article class="group--teaser"></article>'
    rows_, rejected = notices.participation_entries(spark.createDataFrame([(1, "https://b.de/p", card + bad)], "page_id int, url string, html string"))
    r = rows_.first()
    assert (r.id, r.title, r.short_status, r.open, r.extra) == ("beteiligung:projekt-park", "Park neu", "Beteiligung läuft", True, "7 Ideen laut Plattform")
    assert rejected.first().rejected == 2
    lists = spark.createDataFrame([("u", y) for y in range(2020, 2028)], "url string, year int")
    assert [r[1] for r in rows(notices.select_list_years(lists, "2026-05-05", 2025))] == [2025, 2026]


def test_feeds(spark):
    body = ('<?xml version="1.0"?><rss version="2.0"><channel><title>T</title>'
            '<item><title>Rat | 12.10.2026 - 17:00 (Sitzung AVR/0008/2026)</title><link>https://h.de/x?si34706</link><description><![CDATA[Sonder <table><tr><td>Ort:</td><td>Saal &amp; Hof</td></tr><tr><td>Gremium:</td><td>Rat K</td></tr></table>]]></description></item>'
            '<item><title>Niederschrift</title><link>https://h.de/y</link></item><item><title>Rat | 12.10.2026 - 17:00 (Sitzung 2)</title><link>http://h.de/y</link></item></channel></rss>')
    press = ('<rss><channel><title>P</title><item><title>Neu</title><link>https://h.de/p</link><guid>g1</guid><pubDate>Mon, 05 Oct 2026 23:30:00 +0200</pubDate><description>&lt;p&gt;Text&lt;/p&gt;</description></item>'
             '<item><title>Ohne Datum</title><link>https://h.de/q</link></item></channel></rss>')
    df = spark.createDataFrame([("s", "https://h.de/rss", "sitzungen", body), ("p", "https://h.de/rss", "presse", press), ("k", "https://h.de/rss", "presse", "<html></html>")],
                               "source_id string, url string, kind string, body string")
    got, rejected, failed = feeds.hints(df, "2026-10-12T00:00:00+00:00")
    r = {x.id: x for x in got.collect()}
    s = r["sitzung:AVR/0008/2026"]
    assert (s.date, s.time, s.place, s.committee, s.short_text, s.refers_to, s.title) == ("2026-10-12", "17:00", "Saal & Hof", "Rat K", "Sonder", "meetings/34706", "Rat – Sitzung AVR/0008/2026")
    assert (r["g1"].date, r["g1"].short_text) == ("2026-10-05", "Text") and len(r) == 2
    assert rows(rejected) == [("p", 1, 1), ("s", 1, 2)] and rows(failed, "source_id") == [("k",)]


def test_open_data(spark):
    cat = [{"identifier": "id1", "title": "Baustellen im Stadtgebiet", "license": "", "modified": "2026-01-02T00:00", "publisher": {"name": "Amt"},
            "distribution": [{"license": "dl-de/by-2-0", "data": {"format": "pdf", "downloadURL": "https://x/a.pdf"}}, {"data": {"mediaType": "text/csv", "downloadURL": "http://x/b.csv", "accessURL": "https://x/b"}}]},
           {"identifier": "id2", "title": "Bäume", "license": "CC BY 2.0"}, {"identifier": "12345678-1234-1234-1234-123456789012", "title": "U", "license": "dl-zero-de/2.0"}]
    raw = spark.createDataFrame([("s", i, json.dumps(d)) for i, d in enumerate(cat)], "source_id string, position int, dataset string")
    ds = opendata.datasets(raw)
    lic = {r.dataset_id: (r.licence_kind, r.licence_text) for r in opendata.classify_licence(ds).collect()}
    assert lic["id1"] == ("by", "Datenlizenz Deutschland – Namensnennung – Version 2.0 (Namensnennung: Amt)") and lic["id2"][0] is None
    assert lic["12345678-1234-1234-1234-123456789012"][0] == "zero"
    wanted = spark.createDataFrame([("s", 0, "baustellen im"), ("s", 1, "Baustellen Köln"), ("s", 2, "12345678-1234-1234-1234-123456789012"), ("s", 3, "xyz")], "source_id string, entry_no int, entry string")
    chosen, counters = opendata.select_datasets(ds, wanted)
    assert rows(chosen, "entry_no", "dataset_id", "kind") == [(0, "id1", 1), (2, "12345678-1234-1234-1234-123456789012", 0)]
    assert tuple(counters.first()) == ("s", 4, 1, 1)
    tab = opendata.tabular_distributions(ds)
    assert rows(tab, "dataset_id", "index") == [("id1", 1)] and opendata.original_urls(tab).first().original_url == "https://x/b"
    objs = {"count": 3, "results": [{"id": "A 1", "Maßnahme": "Kanal", "beginn_datum": "1.2.2026", "ende": "2026-12-01", "x": None, "ja": True}, {"hinweis": "nur", "tief": {"a": 1}}]}
    lists = {"results": [["7", "Brücke"]], "schema": {"r": {"fields": {"nr": {}, "name": {}}}}}
    ans = spark.createDataFrame([("id1", 1, 0, json.dumps(objs)), ("id1", 1, 1, json.dumps(lists))], "dataset_id string, index int, page_no int, body string")
    table = opendata.open_data_rows(ans)
    meta = opendata.classify_licence(ds).select("dataset_id", "title", "modified", "licence_text").join(opendata.original_urls(tab), "dataset_id")
    out = {r.title: r for r in opendata.dataset_rows_to_entries(table, meta, "2026-10-12").collect()}
    k = out["Kanal"]
    assert (k.id, k.reference, k.date, k.deadline, k.open) == ("opendata:id1:A-1", "A 1", "2026-02-01", "2026-12-01", True)
    assert k.short_text == "beginn datum: 1.2.2026 · ende: 2026-12-01 · ja: ja" and out["Brücke"].id == "opendata:id1:7"
    import hashlib
    assert out["Baustellen im Stadtgebiet – Zeile 2"].id == "opendata:id1:z" + hashlib.sha256("7:hinweis3:nur4:tief0:".encode()).hexdigest()


def test_registers(spark, tmp_path):
    ext = [("Venloer Str.", "50823", "", "1", "E", "Ehrenfeld")] * 3 + [("Venloer Straße", "50827", "", "1", "E", "Bickendorf")] * 2 + [
        ("A-Weg", "99999", "", "1", "E", "Ehrenfeld"), ("", "50823", "", "1", "E", "Ehrenfeld"), ("B", "50823", "", "1", "E", "Marsdorf"), ("C", "50823", "", "2", "E", "Ehrenfeld")]
    df = spark.createDataFrame(ext, registers.EXTRACT)
    q = spark.createDataFrame([("Ehrenfeld", "401"), ("Bickendorf", "403")], "name string, quarter string")
    p = spark.createDataFrame([("50823",), ("50827",)], "plz string")
    pq, pp, rej = registers.register_counts(registers.classify_streets(df, q, p, "1"))
    assert rows(pq) == [("venloer strasse", "401", 3), ("venloer strasse", "403", 2)]
    assert rows(rej) == [("ausserhalb_plz", 1), ("fremde_gemeinde", 1), ("ohne_namen", 1), ("unbekannter_stadtteil", 1)]
    assert rows(registers.postcode_quarters(pq, pp), "plz", "quarter") == [("50823", "401"), ("50827", "401")]
    reg = registers.build_register(pq, pp)
    path = str(tmp_path / "reg")
    registers.write_register(reg, path, ["Quelle: Q", "Stand: heute"])
    streets, head, bad = registers.read_register(spark, path, "k")
    assert rows(streets, "name", "postcodes") == [("venloer strasse", ["50823", "50827"])] and rows(head) == [("Quelle", "Q"), ("Stand", "heute")] and bad.count() == 0
    b = spark.createDataFrame([("E", 4, "Ehrenfeld")], "borough string, nr int, name string")
    quarters, plz = registers.build_hierarchy(df, b)
    assert rows(quarters) == [("401", "Bickendorf", "4"), ("402", "Ehrenfeld", "4"), ("403", "Marsdorf", "4")] and plz.count() == 0
    assert registers.unmapped_boroughs(df, b).count() == 0
    refs = spark.createDataFrame([("k", 0, "KStA", "T", "https://x", "2026-01-01", ["Radweg"], []), ("k", 1, "", "T", "https://x", "", ["a"], []), ("k", 2, "M", "T", "ftp://x", "", ["a"], []),
                                  ("k", 3, "M", "T", "https://x", "2026-13-01", ["a"], []), ("k", 4, "M", "T", "https://x", "", ["!"], [])],
                                 "city string, pos int, medium string, title string, url string, date string, keywords array<string>, references array<string>")
    good, errors = registers.load_press(refs)
    assert rows(good, "pos", "keywords") == [(0, ["radweg"])] and rows(errors, "pos") == [(1,), (2,), (3,), (4,)]


def test_named_references_are_read_from_short_lists(spark):
    from html.entities import html5

    from townledger.functions import html as H
    parts = H.NAMES.split(H.LIST)
    assert len(parts) == H.LISTS and max(len(p) for p in parts) < 400  # every look-up reads one of them
    names = list(html5)
    got = spark.createDataFrame([(k,) for k in names], "k string").select("k", H.unescape(F.concat(F.lit("&"), "k")).alias("v")).collect()
    assert len(got) == len(names) and all(r.v == html5[r.k] for r in got)


def test_notice_titles_are_worked_out_once(spark):
    from townledger.sources import notices
    pages = spark.createDataFrame([("1", "https://stadt.example/liste", "")], "page_id string, url string, html string")
    plan = notices.notice_entries(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<figcaption") == 1


def test_table_rows_are_parsed_once(spark):
    answers = spark.createDataFrame([("d", 1, 1, '{"count":2,"results":[{"a":"1"},7]}')], "dataset_id string, index int, page_no int, body string")
    got = opendata.open_data_rows(answers)
    assert [(r.number, [tuple(c) for c in r.cells]) for r in got.collect()] == [(1, [("a", "1")])]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("map_entries(") == 1
