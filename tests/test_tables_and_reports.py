import random

from pyspark.sql import functions as F

from townledger.operators import reports as R
from townledger.operators import tables as T
from townledger.operators import timeline as L
from townledger.operators.topk import previous_value, top_per_group


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_upsert_and_children(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, s string")
    new = spark.createDataFrame([("b", 5), ("c", 6)], "id string, n int")
    once = T.upsert(old, new, ["id"])
    assert rows(once) == [("a", 1, "x"), ("b", 5, "y"), ("c", 6, None)] and rows(T.upsert(once, new, ["id"])) == rows(once)
    kids = spark.createDataFrame([("k1", "a"), ("k2", "b")], "id string, record_id string")
    fresh = spark.createDataFrame([("k3", "b")], "id string, record_id string")
    touched = spark.createDataFrame([("b",)], "record_id string")
    assert rows(T.replace_children(kids, fresh, "record_id", touched)) == [("k1", "a"), ("k3", "b")]
    assert {r.id: r.is_new for r in T.classify_batch(old, new, ["id"]).collect()} == {"b": False, "c": True}


def test_snapshots_and_previous_value(spark):
    obs = spark.createDataFrame([(i, "a", h) for i, h in enumerate("AABBAA", 1)], "seq long, id string, content_hash string")
    kept = T.changed_only(obs, ["id"], "seq", F.floor(F.col("seq") / 2))
    assert rows(kept, "seq", "content_hash") == [(1, "A"), (3, "B"), (5, "A")]
    hist = kept.limit(0)
    appended = T.append_changed_snapshots(hist, obs.filter("seq <= 3"))
    assert rows(appended, "seq") == [(1,), (3,)]
    more = T.append_changed_snapshots(appended, obs)
    assert rows(more, "seq") == [(5,)]
    rng = random.Random(1)
    data = [(k, s, rng.choice("xyz")) for k in "pq" for s in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(data, "id string, seq int, v string")
    got = {(r.id, r.seq): (r.prev if r.has_prev else None) for r in previous_value(df, ["id"], "seq", F.floor(F.col("seq") / 37), "v", "prev").collect()}
    expected = {}
    for k in "pq":
        last = None
        for _, s, v in sorted(x for x in data if x[0] == k):
            expected[(k, s)], last = last, v
    assert got == expected


def test_top_per_group_salted(spark):
    rng = random.Random(2)
    data = [("hot" if i % 3 else f"g{i % 7}", rng.randint(0, 50), i) for i in range(500)]
    df = spark.createDataFrame(data, "g string, d int, id int")
    got = rows(top_per_group(df, ["g"], [F.col("d").desc(), F.col("id")], 5, salt_by=["id"]), "g", "rank", "id")
    expected = []
    for g in {x[0] for x in data}:
        best = sorted((x for x in data if x[0] == g), key=lambda x: (-x[1], x[2]))[:5]
        expected += [(g, i + 1, x[2]) for i, x in enumerate(best)]
    assert got == sorted(expected)


def test_list_closure_soft_delete_and_samples(spark):
    plans = spark.createDataFrame([("p1", "s", "r2", True), ("p2", "s", "r1", True), ("p3", "t", "r1", True)], "id string, source_id string, run_id string, listed boolean")
    runs = spark.createDataFrame([("s", "r2", True), ("t", "r2", False)], "source_id string, run_id string, complete boolean")
    assert {r.id: r.listed for r in T.close_list(plans, runs).collect()} == {"p1": True, "p2": False, "p3": True}
    t = {"records": spark.createDataFrame([("a", "s", False), ("b", "real", False)], "id string, source_id string, deleted boolean"),
         "consultations": spark.createDataFrame([("c", "a", False)], "id string, record_id string, deleted boolean"),
         "documents": spark.createDataFrame([("d", "a", "", False)], "id string, record_id string, meeting_id string, deleted boolean"),
         "places": spark.createDataFrame([("a", "plz", "1", "betreff"), ("b", "plz", "1", "betreff")], "id string, type string, key string, provenance string")}
    out = T.soft_delete(t, "record", spark.createDataFrame([("a",)], "id string"))
    assert rows(out["records"]) == [("a", "s", True), ("b", "real", False)] and rows(out["places"], "id") == [("b",)]
    assert out["consultations"].first().deleted and out["documents"].first().deleted
    sources = spark.createDataFrame([("s", True), ("real", False)], "id string, sample boolean")
    batch = spark.createDataFrame([("a", "real"), ("b", "s"), ("z", "s")], "id string, source_id string")
    assert rows(T.real_over_sample(t["records"], batch, sources), "id", "source_id") == [("a", "real"), ("z", "s")]
    assert rows(T.first_real_loads(t["records"], batch, sources)) == [("a",)]
    gone = T.purge_source(t, "s")
    assert rows(gone["records"], "id") == [("b",)] and gone["documents"].count() == 0 and rows(gone["places"], "id") == [("b",)]


def test_places_by_provenance_and_diff(spark):
    cols = "id string, type string, key string, provenance string"
    old = spark.createDataFrame([("a", "plz", "1", "betreff"), ("a", "plz", "2", "oparl"), ("b", "plz", "3", "betreff")], cols)
    new = spark.createDataFrame([("a", "plz", "9", "betreff")], cols)
    touched = spark.createDataFrame([("a",)], "id string")
    out = T.replace_places(old, new, touched, ("betreff", "beschreibung", "strasse"))
    assert rows(out, "id", "key") == [("a", "2"), ("a", "9"), ("b", "3")]
    assert rows(T.place_diff(old, out), "key", "change") == [("1", "removed"), ("9", "added")]


def test_council_status(spark):
    recs = spark.createDataFrame([("v1", "s"), ("v2", "s"), ("v3", "s")], "id string, source_id string")
    cons = spark.createDataFrame([("c1", "v1", "m1", "t1", ["g1", "x/9"], "", False, False), ("c2", "v1", "m2", "", [], "Beratung", True, False),
                                  ("c3", "v2", "m1", "t2", ["g1"], "", False, False), ("c4", "v3", "zz", "", [], "", False, False)],
                                 "id string, record_id string, meeting_id string, agenda_item_id string, committee_ids array<string>, role string, authoritative boolean, deleted boolean")
    meet = spark.createDataFrame([("m1", "Rat", "2026-01-01", False, ["g1"], False), ("m2", "BV", "2026-12-24", False, ["g2"], False)],
                                 "id string, name string, date string, cancelled boolean, committee_ids array<string>, deleted boolean")
    items = spark.createDataFrame([("t1", "1.1", "TOP", "beschlossen", 1, False), ("t2", "2", "TOP", "abgelehnt", 2, False)],
                                  "id string, number string, name string, result string, item_order int, deleted boolean")
    com = spark.createDataFrame([("g1", "Rat"), ("g2", "")], "id string, name string")
    tl = L.council_timeline(cons, recs, meet, items, com, "2026-10-12")
    names = {r.consultation_id: r.committee for r in tl.collect()}
    assert names == {"c1": "Rat / Gremium 9", "c2": "g2", "c3": "Rat", "c4": "Gremium unbekannt"}
    st = {r.id: (r.short, r.status_text, r.open) for r in L.council_status(tl).collect()}
    assert st["v1"] == ("anstehend", "Nächste Beratung: g2 am 24.12.2026", True)
    assert st["v2"] == ("abgelehnt", "Letzte Entscheidung: Rat am 01.01.2026: abgelehnt", False)
    assert st["v3"][0] == "in Beratung"


def test_plan_and_entry_status(spark):
    cols = "id string, phase string, begin string, end string, permission string, listed boolean, seen string, organisation string"
    plans = spark.createDataFrame([("a", "P", "2026-11-01", "2026-12-01", "write", True, "", "O"), ("b", "P", "2026-01-01", "2026-10-12", "write", True, "", "O"),
                                   ("c", "P", "2026-01-01", "2026-02-01", "", True, "", "O"), ("d", "P", "", "", "", False, "2026-05-05T10:00:00+00:00", "O"),
                                   ("e", "P", "2026-01-01", "", "read", True, "", "O")], cols)
    st = {r.id: (r.short, r.open) for r in L.plan_status(plans, "2026-10-12 10:00:00").collect()}
    assert st == {"a": ("Beteiligung anstehend", True), "b": ("Beteiligung läuft", True), "c": ("Beteiligungsfrist beendet", False),
                  "d": ("nicht mehr gelistet", False), "e": ("P", False)}
    snap = spark.createDataFrame([("a", 1, "2026-05-01T08:00:00+00:00", ("T", "P", "", "", "", "O", "")),
                                  ("a", 2, "2026-06-01T08:00:00+00:00", ("T", "Q", "2026-11-01", "", "", "O", ""))],
                                 "id string, seq int, observed string, content struct<title:string,phase:string,begin:string,end:string,description:string,organisation:string,permission:string>")
    tl = L.plan_timeline(plans.filter("id = 'a'"), snap, "2026-10-12").orderBy("at", "seq").collect()
    assert [r.kind for r in tl] == ["beobachtung", "beobachtung", "beteiligung", "beteiligung"]
    assert tl[1].description == "Geändert: Phase, Beteiligungsbeginn (bemerkt beim Laden). Q · 01.11.2026 – ohne Frist"
    ent = spark.createDataFrame([("x", "2026-01-02", "", "amtlich", "Text.", False, "2026-03-04T00:00", True, "K", "S")],
                                "id string, date string, short_text string, short_status string, status_text string, open boolean, seen string, is_notice boolean, category string, step string")
    assert L.entry_status(ent).first().status_text == "Text. (geladen am 04.03.2026)"
    assert [r.event for r in L.entry_timeline(ent, "2026-01-01").orderBy("pos").collect()] == [
        "Bekanntmachung erschienen", "Zuletzt geladen"]


def test_failures_and_demand(spark):
    runs = spark.createDataFrame([(i, "s", st) for i, st in enumerate(["ok", "gesperrt", "nicht erreichbar"])] + [(9, "t", "ok")], "id int, source_id string, status string")
    assert {r.source_id: r.failures for r in R.consecutive_failures(runs).collect()} == {"s": 2, "t": 0}
    rng = random.Random(3)
    base = 1_700_000_000
    events = [("dense", base + t) for t in range(0, 200_000, 37)] + [("sparse", base + rng.randint(0, 10_000_000)) for _ in range(300)]
    df = spark.createDataFrame(events, "city string, s long").select("city", F.timestamp_seconds("s").alias("at"))
    got = {r.city: (int(r.f), int(r.l), r.n) for r in R.demand(df).select("city", F.unix_timestamp("first_at").alias("f"), F.unix_timestamp("last_at").alias("l"), "n").collect()}
    for city in ("dense", "sparse"):
        last, first, n = None, None, 0
        for t in sorted(e[1] for e in events if e[0] == city):
            if last is None or t - last >= 600:
                last, n = t, n + 1
                first = t if first is None else first
        assert got[city] == (first, last, n)


def test_report_of_a_source_without_rows_has_empty_lists(spark):
    from checks import q_reports

    def t(name):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        if name == "events":
            df = df.unionByName(df.limit(8).withColumn("user_id", F.lit(1000).cast(df.schema["user_id"].dataType)))
        return df

    got = {r.id: (r.records, r.n_runs, r.n_documents) for r in q_reports.load_report(t).collect()}
    assert got["1000"] == (0, 8, 0)
    assert R.report_totals(q_reports.report(t)).first().hints[-1].startswith("Gezeigt")
