"""Staged search against a plain formulation on small and random stocks."""

import random

from helpers import CITY, dims

from pyspark.sql import functions as F

from townledger.operators import search as S
from townledger.operators.terms import match_many_terms, match_terms

REQ = ("request_id string, city string, places array<struct<type:string,key:string>>, plz string, themes array<string>, "
       "words array<string>, date_from string, date_to string, open boolean, limit int, offset int")
TODAY = "2026-10-12"


def req(rid, places=(), plz=None, themes=(), words=(), dfrom=None, dto=None, is_open=False, limit=20, offset=0):
    return (rid, CITY, list(places), plz, list(themes), list(words), dfrom, dto, is_open, limit, offset)


def stock(spark):
    recs = [("r1", CITY, "2026-09-01", "Wohnungsbau in Ehrenfeld", "wohnungsbau in ehrenfeld feldgaertenstr"),
            ("r2", CITY, "2020-01-01", "Radweg Nippes", "radweg nippes verkehr"),
            ("r3", CITY, "", "Abendmärkte", "abendmaerkte auf dem platz"),
            ("r4", CITY, "2025-01-01", "Schule Ehrenfeld", "schule ehrenfeld bauvorhaben"),
            ("r5", "nordhausen", "2026-01-01", "Schule", "schule ehrenfeld")]
    places = [("r1", "stadtteil", "401", "betreff"), ("r1", "bezirk", "4", "betreff"), ("r2", "bezirk", "5", "betreff"),
              ("r4", "stadtteil", "401", "strasse"), ("r4", "plz", "50823", "betreff")]
    return (spark.createDataFrame(recs, "id string, city string, date string, title string, search_text string"),
            spark.createDataFrame(places, "id string, type string, key string, provenance string"))


def run(spark, requests, cap=3000, status=None):
    recs, places = stock(spark)
    out = S.search(spark.createDataFrame(requests, REQ), recs, places, dims(spark), TODAY, status, cap).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.request_id, r["rank"])):
        got.setdefault(r.request_id, []).append((r.id, r.score, r.stage, r.total))
    return got


def test_stages_and_scores(spark):
    q = [("stadtteil", "401")]
    got = run(spark, [
        req("place", q), req("word", words=["Abendmärkten"]), req("and", q, words=["Schule", "xyzxyz"]),
        req("or", words=["Schule", "Abendmarkt", "radweg"]), req("none", words=["xyzxyz"]), req("theme", themes=["bauen"]),
        req("all"), req("range", dfrom="2025-01-01", dto="2026-10-01"), req("upto", dto="2021-01-01"), req("plz", plz="50823"),
        req("street", words=["Feldgärtenstraße"]), req("open", q, is_open=True), req("page2", limit=1, offset=1),
        req("unknown", [("stadtteil", "999")], words=["xyzxyz"]), req("onlyblank", words=["!!"])])
    assert got["place"] == [("r1", 6, 1, 2), ("r4", 3 + 2 + 1, 1, 2)]
    assert got["word"] == [("r3", 0, 1, 1)]
    assert [x[0] for x in got["and"]] == ["r4", "r1"] and got["and"][0][2] == 2
    assert [x[0] for x in got["or"]] == ["r4", "r2"] and got["or"][0][2] == 3
    assert "none" not in got
    assert got["theme"] == [("r1", 5, 1, 2), ("r4", 3, 1, 2)]
    assert [x[0] for x in got["all"]] == ["r1", "r4", "r2", "r3"]
    assert [x[0] for x in got["range"]] == ["r1", "r4"]
    assert [x[0] for x in got["upto"]] == ["r2", "r3"]
    assert got["plz"][0] == ("r4", 3 + 4 + 1, 1, 2)
    assert [x[0] for x in got["street"]] == ["r1"]
    assert got["open"][0] == ("r1", 9, 1, 2)
    assert [x[0] for x in got["page2"]] == ["r4"]
    assert [x[2] for x in got["unknown"]] == [2] * 4
    assert len(got["onlyblank"]) == 4


def test_cap_keeps_newest(spark):
    got = run(spark, [req("all")], cap=2)
    assert [x[0] for x in got["all"]] == ["r1", "r4"] and got["all"][0][3] == 2


def test_blocks_give_the_pages_of_the_pairs(spark):
    """Many requests against many records keep no row per pair; pages, scores and totals are those of the pairs."""
    rng = random.Random(11)
    words = ["schule", "schulen", "strasse", "feldstr", "feldstrasse", "radweg", "verkehr", "bau", "bauvorhaben", "platz", "abend", "am"]
    days = ["", None, "2019-05-01", "2024-10-11", "2024-10-12", "2025-03-01", "2026-01-01"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    recs = [(f"r{i}", CITY if i % 9 else "nordhausen", rng.choice(days), some(4), some(12)) for i in range(90)]
    kinds = [("stadtteil", "401"), ("stadtteil", "501"), ("bezirk", "4"), ("bezirk", "5"), ("plz", "50823"), ("plz", "50827")]
    places = [(f"r{rng.randrange(90)}", *rng.choice(kinds), rng.choice(["betreff", "strasse"])) for _ in range(150)]
    open_ = [(f"r{i}", i % 3 == 0) for i in range(0, 90, 2)]
    asked = [req(f"q{i}", rng.sample(kinds[:4], rng.randint(0, 2)) if i % 3 == 0 else (), rng.choice(["50823", None, None, None]), ["bauen"] if i % 7 == 0 else (),
                 [rng.choice([*words, "Feldstraße", "Schul-Platz", "xyz", "!!", "schule radweg"]) for _ in range(rng.randint(0, 4))],
                 rng.choice([None, None, "2024-10-12"]), rng.choice([None, None, "2026-01-01"]), i % 2 == 0, rng.randint(0, 6), rng.randint(0, 2)) for i in range(120)]
    recs = spark.createDataFrame(recs, "id string, city string, date string, title string, search_text string")
    places = spark.createDataFrame(places, "id string, type string, key string, provenance string")
    asked = spark.createDataFrame(asked, REQ)
    status = spark.createDataFrame(open_, "id string, open boolean")
    pages = [S.search(asked, recs, places, dims(spark), TODAY, status, many=n) for n in (0, 10 ** 9)]
    got, expected = ([tuple(r) for r in p.select(*sorted(pages[1].columns)).orderBy("request_id", "rank").collect()] for p in pages)
    assert len(expected) > 100 and got == expected
    d, picked = dims(spark).settled(), []
    for size, part in ((2048, 16_384), (7, 50)):
        rows = S.best_rows(S.ask(asked, d), recs, places, TODAY, status, size, part)
        picked.append(sorted({(r.request_id, r.stage, r.total) for r in rows.collect()}))
    assert picked[0] == picked[1]


def test_blocks_keep_what_the_pages_need(spark):
    """However many blocks and steps the records are dealt into, a request keeps the rows of its page only, and they are the same."""
    rng = random.Random(12)
    recs = [(f"r{i:02d}", CITY, rng.choice(["", None, "2024-01-01", "2025-03-01"]), "Radweg", " ".join(rng.sample(["radweg", "schulweg", "schule", "markt", "am", "platz"], rng.randint(0, 5)))) for i in range(80)]
    recs += [("r00", CITY, "2025-03-01", "Platz", "am platz am platz"), (None, CITY, "2025-03-02", "Platz", "schule radweg")]
    recs = spark.createDataFrame(recs, "id string, city string, date string, title string, search_text string")
    places = spark.createDataFrame([(f"r{i:02d}", "stadtteil", "401", "betreff") for i in range(0, 80, 3)], "id string, type string, key string, provenance string")
    for phrase in ("am platz", "atz"):
        asked = [req(f"q{i}", [("stadtteil", "401")] if i % 3 == 0 else (), None, ["verkehr"] if i % 5 == 0 else (), rng.sample(["weg", "Schule", "markt", phrase, "rad", "nie"], rng.randint(1, 3)),
                     None, rng.choice([None, "2025-01-01"]), False, rng.choice([0, 1, 3]), rng.choice([0, 1])) for i in range(40)]
        asked = S.ask(spark.createDataFrame(asked, REQ), dims(spark).settled())
        needed = asked.shapes.selectExpr("sum(limit + offset)").first()[0]
        pairs = S.candidates(S.pair_rows(asked, recs.filter("id IS NOT NULL"), places).withColumn("stage", F.explode(F.expr("filter(array(if(stages & 1 > 0, 1, 0), if(stages & 2 > 0, 2, 0), if(stages & 4 > 0, 3, 0)), x -> x > 0)"))))
        first = {r.request_id: r.stage for r in pairs.select("request_id", "stage").distinct().collect()}
        kept = []
        for size, part, step in ((2048, 16_384, 2048), (9, 7, 9), (30, 11, 4)):
            rows = S.best_rows(asked, recs, places, TODAY, None, size, part, step).collect()
            assert len(rows) <= needed and all(first.get(r.request_id, r.stage) >= r.stage for r in rows)
            kept.append(sorted((r.request_id, r.stage, r.total, str(r.date), r.points, r.word_points, r.theme_points) for r in rows))
        assert len(kept[0]) > 40 and kept[0] == kept[1] == kept[2]


def test_many_terms_equal_few_terms_and_brute_force(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    rows = [(str(i), " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    terms = sorted({w[: rng.randint(1, len(w))] for w in words} | {" ".join(rng.sample(words, 2)) for _ in range(40)}
                   | {r[1][3:14].strip() for r in rows if len(r[1]) > 14})
    texts = spark.createDataFrame(rows, "id string, text string")
    tdf = spark.createDataFrame([(t,) for t in terms], "term string")
    expected = {(i, t) for i, x in rows for t in terms if t and t in x}
    for df in (match_terms(texts, tdf, few=10_000), match_many_terms(texts, tdf)):
        got = [(r.id, r.term) for r in df.collect()]
        assert len(got) == len(set(got)) and set(got) == expected
