"""The ways taken beyond a size against plain loops and against the ways taken below it."""

import random

from helpers import CITY, dims
from test_search import REQ, TODAY, req

from townledger.operators import places as P
from townledger.operators import search as S
from townledger.operators import terms as M
from townledger.operators.names import NameFilter
from townledger.session import left_join
from townledger.sources import opendata


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_day_lists_equal_pairs(spark):
    """Pages and totals of requests without a constraint but the date, against all their pairs."""
    rng = random.Random(4)
    days = ["", "2020-01-01", "2021-05-05", "2023-12-31", "2025-01-01", "2025-03-01", "2026-02-02", "2026-02-03"]
    recs = [(f"r{i:03d}", rng.choice([CITY, CITY, "nordhausen"]), None if i % 19 == 0 else rng.choice(days), rng.choice(["Radweg Nippes", "Schule", "Markt"]),
             rng.choice(["radweg nippes verkehr", "schule ehrenfeld bauvorhaben", "markt", "wohnungsbau schule"])) for i in range(160)]
    records = spark.createDataFrame(recs, "id string, city string, date string, title string, search_text string")
    places = spark.createDataFrame([(f"r{i:03d}", "stadtteil", "401", "betreff") for i in range(0, 160, 7)], "id string, type string, key string, provenance string")
    status = spark.createDataFrame([(f"r{i:03d}", i % 2 == 0) for i in range(0, 160, 3)], "id string, open boolean")
    requests = [req("all"), req("none", dfrom="2030-01-01"), req("zero", limit=0), req("turned", dfrom="2025-01-01", dto="2020-01-01"), req("blank", words=["!!"])]
    for i in range(24):
        a, b = rng.choice([None, *days]), rng.choice([None, *days, "2026-02-04"])
        requests.append(req(f"d{i}", dfrom=a, dto=b, is_open=i % 2 == 0, limit=rng.choice([1, 5, 40]), offset=rng.choice([0, 3, 30])))
        requests.append(req(f"u{i}", [("stadtteil", "999")], words=rng.choice([["xyzxyz"], ["Schule", "xyzxyz"], ["Schule"], ["Radweg", "Schule"]]), dfrom=a, is_open=i % 3 == 0, limit=12, offset=i % 4))
        requests.append(req(f"p{i}", [("stadtteil", "401")], words=["Schule"] * (i % 2), dto=b, limit=6))
    asked, d = spark.createDataFrame(requests, REQ), dims(spark)
    cols = ("request_id", "rank", "id", "score", "stage", "total")
    pairs = S.match_pairs(asked, records, places, d)
    assert rows(S.search(asked, records, places, d, TODAY, status), *cols) == rows(S.page(S.score(S.candidates(pairs), status, TODAY), asked), *cols)
    seen = []

    def some(ids):
        seen.append(ids.count())
        return status.join(ids, "id", "left_semi")

    few = asked.filter("request_id like 'p%' OR request_id = 'd1'")
    assert rows(S.search(few, records, places, d, TODAY, some), *cols) == rows(S.search(few, records, places, d, TODAY, status), *cols)
    plain = asked.filter("size(words) = 0 AND size(places) = 0")
    assert rows(S.range_totals(plain, records, d), "request_id", "matches") == rows(S.uncapped_totals(S.match_pairs(plain, records, places, d)), "request_id", "matches")


def test_frequent_words_are_joined_apart(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 8))) for _ in range(90)]
    data = [(str(i), " ".join(["haeufig", *(rng.choice(words) for _ in range(rng.randint(0, 12)))])) for i in range(120)]
    terms = sorted({w[:rng.randint(2, len(w))] for w in words} | {"haeuf", "haeufig", "ufi"} | {f"haeufig {words[0]}"})
    texts, tdf = spark.createDataFrame(data, "id string, text string"), spark.createDataFrame([(t,) for t in terms], "term string")
    expected = {(i, t) for i, x in data for t in terms if t in x}
    monkeypatch.setattr(M, "HEAVY", 8)
    for rows_ in (0, 100_000):
        got = [(r.id, r.term) for r in M.match_many_terms(texts, tdf, rows=rows_).collect()]
        assert len(got) == len(set(got)) and set(got) == expected


def test_large_street_register(spark):
    names = [f"{a}{b} strasse" for a in ("venloer", "berg", "lange") for b in range(40)] + ["am alten markt", "venloerweg", "ring strasse"]
    streets = spark.createDataFrame([(CITY, n) for n in names], "city string, name string")
    rng = random.Random(6)
    texts = [(CITY, str(i), 0, " ".join(rng.choice(["Venloer7 Str.", "am alten Markt", "Markt", "Venloerweg", "lange39 Straße", "Ring", "strasse", "nichts"]) for _ in range(9)), "betreff", False) for i in range(60)]
    df = spark.createDataFrame(texts, "city string, id string, part int, text string, provenance string, districts_only boolean")
    few, many = P.match_streets(df, streets), P.match_streets(df, streets, rows=10)
    assert rows(few) == rows(many) and few.count() > 50
    kept = NameFilter(streets, ["city", "name"]).keep(spark.createDataFrame([(CITY, f"fremd{i}") for i in range(3000)] + [(CITY, n) for n in names], "city string, name string"))
    assert len(names) <= kept.count() <= len(names) + 60 and kept.join(streets, ["city", "name"], "left_semi").count() == len(names)


def test_datasets_equal_a_plain_search(spark):
    rng = random.Random(7)
    words = ["Baustellen", "Stadt", "Köln", "Baum", "Kataster", "Baumkataster", "im", "Rad", "Radwege", "Verkehr", "und", "Bau"]
    titles = [("st"[rng.randrange(2)], i, f"ID-{i:02d}" if i % 9 else "", " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))) for i in range(70)]
    titles.append(("s", 70, "12345678-1234-1234-1234-123456789ABC", "Baustellen"))
    entries = [("st"[rng.randrange(2)], i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))) for i in range(60)]
    entries += [("s", 60, "12345678-1234-1234-1234-123456789abc "), ("s", 61, "12345678-1234-1234-1234-000000000000"), ("s", 62, ""), ("s", 63, "aum"), ("t", 64, "au kat"), ("s", 65, "Nichts davon"), ("t", 66, "adt Koeln Bau")]

    def plain(x):
        return "".join(c if c.isalnum() else " " for c in x.lower().replace("ö", "oe")).strip()

    best, chosen = {}, {}
    for s, no, e in entries:
        found = []
        for t, pos, key, title in titles:
            if t == s:
                n, tn = plain(e), plain(title)
                if e.strip().count("-") == 4:
                    kind = 0 if key.lower() == e.strip().lower() else None
                else:
                    kind = 1 if n and n in tn else 2 if {w for w in n.split() if len(w) >= 4} & set(tn.split()) else None
                if kind is not None:
                    found.append((kind, pos, key, title))
        if found:
            best[s, no] = min(found)
    for (s, no), (kind, _, key, title) in sorted(best.items(), key=lambda x: x[0][1]):
        if key:
            chosen.setdefault((s, key), (s, no, key, title, kind))
    ds = spark.createDataFrame(titles, "source_id string, position int, dataset_id string, title string")
    wanted = spark.createDataFrame(entries, "source_id string, entry_no int, entry string")
    got, counters = opendata.select_datasets(ds, wanted)
    assert rows(got, "source_id", "entry_no", "dataset_id", "title", "kind") == sorted(chosen.values(), key=str)
    want = [(s, sum(x[0] == s for x in entries), sum(k[0] == s and b[0] == 2 for k, b in best.items()), sum(x[0] == s and (s, x[1]) not in best for x in entries)) for s in "st"]
    assert rows(counters) == want


def test_blank_references_find_nothing_and_spread(spark):
    left = spark.createDataFrame([(i, None if i % 3 == 0 else "" if i % 3 == 1 else f"k{i % 5}") for i in range(90)], "id int, key string")
    right = spark.createDataFrame([(f"k{i}", i) for i in range(4)] + [("", 99), (None, 98)], "key string, v int")
    got = left_join(left, right, "key", "id")
    assert got.columns == ["id", "key", "v"] and got.count() == 90
    assert {(r.id, r.v) for r in got.collect()} == {(i, i % 5 if i % 3 == 2 and i % 5 < 4 else None) for i in range(90)}


def test_few_names_equal_word_runs(spark):
    """Names compared inside the row against all word runs that meet the names in a join."""
    from helpers import texts
    rng = random.Random(11)
    bits = ["Eil", "eil", "Eil_", "_Eil", "EIL", "Eíl", "Porz", "porz", "Alte Stadt", "alte", "Stadt", "Bezirk Nord", "BEZIRK 4", "Bezirk\u00a010", "50823", "x50735",
            "Ehrenfeld", "ehrenfeld", "Neu-Ehrenfeld", "Neuehrenfeld", "–", "und", "Mitte", "Musterstadt Mitte", "Näherung"]
    df = texts(spark, [(str(i), rng.choice([" ", ", ", "-"]).join(rng.choice(bits) for _ in range(rng.randint(0, 9))), "betreff", i % 5 == 0) for i in range(150)])
    d = dims(spark)
    g = P.build_gazetteer(d)
    got, expected = P.text_hits(df, g, d), P.text_hits(df, g, d, few=0)
    assert rows(got) == rows(expected) and got.count() > 100


def test_pairs_meet_as_numbers(spark):
    """One aggregation of plain numbers per pair, however many words a request has; the candidates read them once."""
    words = [f"wort{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(130)]
    records = spark.createDataFrame([("r1", CITY, "2025-01-01", "T", " ".join(words)), ("r2", CITY, "2025-01-02", "T", " ".join(words[:-1]))],
                                    "id string, city string, date string, title string, search_text string")
    places = spark.createDataFrame([], "id string, type string, key string, provenance string")
    pairs = S.match_pairs(spark.createDataFrame([req("many", words=words), req("two", words=words[-2:])], REQ), records, places, dims(spark))
    assert rows(pairs, "request_id", "id", "stage", "word_points") == [
        ("many", "r1", 1, 130), ("many", "r1", 3, 130), ("many", "r2", 3, 129), ("two", "r1", 1, 2), ("two", "r1", 3, 2), ("two", "r2", 3, 1)]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    chosen = S.candidates(pairs)
    assert rows(chosen, "request_id", "id", "total") == [("many", "r1", 1), ("two", "r1", 1)]
    assert "search_text" not in chosen._jdf.queryExecution().analyzed().toString()


def test_terms_of_one_word_leave_the_texts(spark):
    """Texts travel to the terms only where terms of several words need the whole text."""
    texts = spark.createDataFrame([("1", "der radweg nippes"), ("2", "die radwege"), ("3", "ab")], "id string, text string")

    def found(terms):
        df = M.match_many_terms(texts, spark.createDataFrame([(t,) for t in terms], "term string"))
        return rows(df), df._jdf.queryExecution().optimizedPlan().toString().count("Join ")

    assert found(["radweg", "wege"]) == ([("1", "radweg"), ("2", "radweg"), ("2", "wege")], 1)
    assert found(["radweg nip", "ab"])[0] == [("1", "radweg nip"), ("3", "ab")]


def test_committees_of_few_lists_equal_each_consultation(spark):
    """Lists of committees named once against names worked out per consultation; the former need no shuffle by consultation."""
    from townledger.operators import timeline as L
    rng = random.Random(5)
    ids = [["g/1"], ["g/2", "g/1"], ["g/9", "x/7"], [], None, ["g/1", "g/2"], ["g/3"]]
    cons = spark.createDataFrame([(f"c{i}", f"m{rng.randint(0, 9)}", rng.choice(ids)) for i in range(60)], "consultation_id string, meeting_id string, committee_ids array<string>")
    meet = spark.createDataFrame([(f"m{i}", rng.choice(ids)) for i in range(8)], "meeting_id string, committee_ids array<string>")
    com = spark.createDataFrame([("g/1", "Rat"), ("g/2", ""), ("g/3", None), ("g/4", "Bau")], "id string, name string")
    chain = left_join(cons, meet.withColumnRenamed("committee_ids", "meeting_committee_ids"), "meeting_id", "consultation_id")
    cols = ("consultation_id", "committee")
    few = L.with_committees(chain, cons, meet, com)
    assert rows(few, *cols) == rows(L.with_committees(chain, cons, meet, com, rows=0), *cols)
    assert {r.committee for r in few.collect()} >= {"Rat", "g/2 / Rat", "Gremium 9 / Gremium 7", "Rat / g/2", "g/3", None}
    assert few.count() == 60


def test_council_pages_are_parsed_once(spark):
    """Elements of a page come from one pass over its body; a job reads the fields it needs and no others."""
    from townledger.sources import council as C
    one = '{"id":"x/1","type":"a/Meeting","agendaItem":[{"id":"i/1","number":1},"i/2"]}'
    bodies = ['{"data":[%s,{"id":"x/2","type":"Paper","name":"Ä \\"b\\""}],"links":{}}' % one, "[%s]" % one, one, '{"data":%s}' % one, '{"data":[]}', '{"data":null,"id":"x/9"}', '{"data":"x"}', "kaputt", '{"data":["u/1",3]}']
    pages = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "url string, body string")
    objs = C.council_objects(pages)
    assert rows(objs, "url", "pos", "type") == [("0", 0, "Meeting"), ("0", 1, "Paper"), ("1", 0, "Meeting"), ("2", 0, "Meeting"), ("3", 0, ""), ("5", 0, ""), ("6", 0, "")]
    items = C.agenda_items(objs)
    assert rows(items, "id", "meeting_id", "number") == [("i/1", "x/1", "1")]
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert "verbatimProtocol" not in plan and plan.count("from_json(StructField(data") == 1


def test_words_without_a_term_are_not_shuffled(spark):
    """With more words than are sent to all tasks, a Bloom filter drops the words that hold no term before the join."""
    texts = spark.createDataFrame([(f"r{i:03d}", " ".join(f"{a}wort{i % 9}{i * 7 % 13}" for a in "abcdefgh") + (" radwege" if i % 3 == 0 else "")) for i in range(120)], "id string, text string")
    terms = spark.createDataFrame([("radweg",), ("cwort45",), ("fehlt",)], "term string")
    df = M.match_many_terms(texts, terms, rows=0)
    assert rows(df) == rows(M.match_many_terms(texts, terms)) and df.filter("term = 'radweg'").count() == 40
    assert "_mask" in df._jdf.queryExecution().analyzed().toString()
