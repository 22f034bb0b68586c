"""Nothing is cut: long answers, long ids, long logs, old lists, large feeds, repeated deliveries."""

import json

from pyspark.sql import functions as F

from townledger.operators import reports, search, tables
from townledger.plans.ingest import ingest_samples
from townledger.sources import council, feeds, notices, opendata

from helpers import dims


def test_answers_of_any_length(spark):
    body = json.dumps({"count": 251, "results": [{"id": f"{'x' * 80}{i}", "n": "1"} for i in range(250)]})
    answers = spark.createDataFrame([("d", 1, 1, body), ("e", 1, 1, '{"count":0,"results":[]}')], "dataset_id string, index int, page_no int, body string")
    rows = opendata.open_data_rows(answers)
    assert rows.count() == 250
    assert [(r.announced, r.read) for r in opendata.announced_gaps(answers).collect()] == [(251, 250)]
    meta = spark.createDataFrame([("d", "T", "", "", "https://x")], "dataset_id string, title string, modified string, licence_text string, original_url string")
    assert opendata.dataset_rows_to_entries(rows, meta, "2026-01-01").select("id").distinct().count() == 250


def test_row_keys_tell_fields_apart(spark):
    rows = [("d", 1, [("a", "b|c=d")]), ("d", 2, [("a", "b"), ("c", "d")])]
    df = spark.createDataFrame(rows, "dataset_id string, number int, cells array<struct<name:string,value:string>>")
    assert df.select(opendata.row_key(F.col("cells"), F.lit("")).alias("k")).distinct().count() == 2


def test_thirty_failures(spark):
    runs = [("s", i, "gesperrt") for i in range(30)] + [("t", 0, "ok"), ("t", 1, "gesperrt"), ("u", 5, None)]
    got = reports.consecutive_failures(spark.createDataFrame(runs, "source_id string, id long, status string"))
    assert {r.source_id: r.failures for r in got.collect()} == {"s": 30, "t": 1, "u": 0}


def test_old_lists(spark):
    lists = spark.createDataFrame([("u", y) for y in range(2009, 2028)], "url string, year int")
    assert {r.year for r in notices.select_list_years(lists, "2026-05-05", 2010).collect()} == set(range(2010, 2027))
    assert {r.year for r in notices.select_list_years(lists, "2026-05-05").collect()} == set(range(2009, 2027))
    assert {r.year for r in notices.select_list_years(lists, "2026-05-05", 2010, years=3).collect()} == {2024, 2025, 2026}


def test_large_feeds_and_long_ids(spark):
    item = "<item><title>N</title><link>https://h.de/p</link><guid>{g}</guid><pubDate>Mon, 05 Oct 2026 23:30:00 +0200</pubDate><description>{d}</description></item>"
    body = "<rss><channel><title>P</title>" + "".join(item.format(g="g" * 300 + str(i), d="x" * 1_600_000) for i in range(2)) + "</channel></rss>"
    df = spark.createDataFrame([("s", "https://h.de/rss", "presse", body)], "source_id string, url string, kind string, body string")
    rows, rejected, failed = feeds.hints(df, "x")
    assert failed.count() == 0 and rows.select("id").distinct().count() == 2


def paper(n, name, **more):
    return {"id": n, "type": "https://schema.oparl.org/1.1/Paper", "name": name, **more}


def pages(spark, *lists):
    data = [(f"https://r.de/p?page={i}", json.dumps({"data": objs})) for i, objs in lists]
    return council.council_objects(spark.createDataFrame(data, "url string, body string")).withColumn("source_id", F.lit("s")).withColumn("city", F.lit("musterstadt"))


def test_last_delivery_wins(spark):
    objs = pages(spark, (2, [paper("a", "old", consultation=[{"id": "c1"}]), paper("b", "first"), paper("b", "second")]),
                 (10, [paper("a", "new", consultation=[{"id": "c2"}])]), (11, [paper("c", "there")]), (12, [paper("c", "", deleted=True)]))
    assert {(r.id, r.title) for r in council.papers(objs).collect()} == {("a", "new"), ("b", "second")}
    assert [r.id for r in council.consultations(objs).collect()] == ["c2"]
    assert [r.id for r in council.deleted_ids(objs, "Paper").collect()] == ["c"]


def test_upsert_takes_a_key_once(spark):
    old = spark.createDataFrame([(1, "x")], "id int, v string")
    batch = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "id int, v string, n int")
    got = tables.upsert(old, batch, ["id"], order=["n"])
    assert {tuple(r) for r in got.collect()} == {(1, "b"), (2, "c")}
    assert tables.upsert(old, batch, ["id"]).count() == 2


def test_samples_do_not_touch_real_objects(spark):
    meeting = {"id": "m1", "type": "x/Meeting", "name": "M", "agendaItem": [{"id": "a1"}], "invitation": {"id": "f1", "name": "I"}}
    objs = pages(spark, (1, [paper("p1", "P", mainFile={"id": "f2", "name": "V"}), paper("p2", "Q", mainFile={"id": "f3", "name": "W"}), meeting,
                             {"id": "o1", "type": "x/Organization", "name": "O"}, paper("p3", "", deleted=True)]))
    sources = spark.createDataFrame([("s", True), ("real", False)], "id string, sample boolean")
    real = {k: spark.createDataFrame([(i, "real") for i in ids], "id string, source_id string") for k, ids in (("records", ["p1", "p3"]), ("meetings", ["m1"]), ("committees", ["o1"]))}
    out = ingest_samples(objs, dims(spark), real, sources)
    ids = {n: sorted(r.id for r in out[n].select("id").collect()) for n in ("records", "meetings", "committees", "agenda_items", "documents", "deleted_records")}
    assert ids == {"records": ["p2"], "meetings": [], "committees": [], "agenda_items": [], "documents": ["f3"], "deleted_records": []}


def test_best_record_may_be_old(spark):
    pairs = spark.createDataFrame([(1, str(i), "c", f"2020-01-{1 + i % 28:02d}", 9 if i == 0 else 0, 0, 1) for i in range(4000)],
                                  "request_id int, id string, city string, date string, points int, word_points int, stage int")
    cands = search.candidates(pairs)
    assert cands.count() == 4000 and cands.first().total == 4000
    asked = spark.createDataFrame([(1, 2, 0)], "request_id int, limit int, offset int")
    got = search.page(cands.withColumn("score", F.col("points")), asked).orderBy("rank").collect()
    assert [r.id for r in got][0] == "0" and len(got) == 2


def test_names_of_rows_are_read_without_their_values(spark):
    """Names and sizes of all answers are what the rows have, whatever shape the rows are in; what names don't say is found in the row."""
    bodies = ['{"count":2,"results":[{"Titel":"A \\u00e4","Beginn":"1.2.2024","x":{"y":[1]}},{"Titel":"B","Titel":"C","ende":null}]}',
              '{"results":[["T1","2024-01-02"],["T2"],[],null,"Wort",{}],"schema":{"s":{"fields":{"titel":{},"datum":{}}}}}', '{"results":[]}', '{"results":{"Titel":"allein"}}', '{}',
              '{"results":["{\\"Titel\\":\\"im Text\\"}","{kaputt"]}']
    answers = spark.createDataFrame([(f"d{i % 2}", 0, i, b) for i, b in enumerate(bodies)], "dataset_id string, index int, page_no int, body string")
    shapes = opendata.row_shapes(answers)
    rows, named = opendata.open_data_rows(answers), opendata.open_data_rows(answers, shapes)
    assert sorted(map(str, rows.collect())) == sorted(map(str, named.collect())) and rows.count() > 7
    lists = {tuple(c["name"] for c in r.cells) for r in rows.collect()}
    assert lists <= {tuple(r[0]) for r in opendata.row_names(shapes).collect()}
    meta = spark.createDataFrame([("d0", "Baustellen", "2026-01-01", "Zero", "https://x"), ("d1", "Rad", "", "", "")], "dataset_id string, title string, modified string, licence_text string, original_url string")
    plain = sorted(map(str, opendata.dataset_rows_to_entries(rows, meta, "2024-01-01").collect()))
    for names in (opendata.row_names(shapes), opendata.row_names(shapes).limit(1)):
        assert sorted(map(str, opendata.dataset_rows_to_entries(named, meta, "2024-01-01", names=names).collect())) == plain
    # the pass for the names parses no value
    plan = opendata.row_names(shapes)._jdf.queryExecution().toString()
    assert "map_entries" not in plan and "entries" not in plan.lower()
