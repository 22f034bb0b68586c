from helpers import CITY, dims, texts

from townledger.operators import places as P
from townledger.operators.dims import dimension_errors


def found(spark, rows, **kw):
    out = P.match_places(texts(spark, rows), dims(spark, **kw)).collect()
    result = {}
    for r in out:
        result.setdefault(r.id, set()).add((r.type, r.key, r.provenance))
    return result


def test_phrases_rollup_short_names_and_numbers(spark):
    got = found(spark, [
        ("a", "Neubau in Neuehrenfeld"), ("b", "Musterstadt-Ehrenfeld, Radweg"), ("c", "ein eil Auftrag"), ("d", "Sanierung in Eil"),
        ("e", "Bezirksvertretung 10"), ("f", "Stadtbezirk 4"), ("g", "PLZ 50823 und 150823"), ("h", "ALTE-STADT"),
        ("i", "Bezirksvertretung 4 (Ehrenfeld)", "gremium", True), ("j", "Bezirk 77, 99999"), ("k", "")])
    assert got["a"] == {("stadtteil", "402", "betreff"), ("bezirk", "4", "betreff")}
    assert got["b"] == {("stadtteil", "401", "betreff"), ("bezirk", "4", "betreff")}
    assert "c" not in got
    assert got["d"] == {("stadtteil", "1001", "betreff"), ("bezirk", "10", "betreff")}
    assert got["e"] == {("bezirk", "10", "betreff")}
    assert "f" not in got and "j" not in got and "k" not in got
    assert got["g"] == {("plz", "50823", "betreff")}
    assert got["h"] == {("stadtteil", "502", "betreff"), ("bezirk", "5", "betreff")}
    assert got["i"] == {("bezirk", "4", "gremium")}


def test_streets(spark):
    got = found(spark, [("a", "Umbau Feldgärtenstr. 12"), ("b", "Venloer Straße"), ("c", "Am Alten Turm"), ("d", "der Markt"),
                        ("e", "Feldgärtenstraße in Niehl"), ("f", "Feldgärtenstraße", "gremium", True)])
    assert got["a"] == {("stadtteil", "501", "strasse"), ("bezirk", "5", "strasse")}
    assert "b" not in got and "d" not in got and "f" not in got
    assert got["c"] == {("stadtteil", "403", "strasse"), ("bezirk", "4", "strasse")}
    assert got["e"] == {("stadtteil", "501", "betreff"), ("bezirk", "5", "betreff")}


def test_street_spelling(spark):
    d = dims(spark)
    rows = P.match_streets(texts(spark, [("q", "Was ist in der (Feldgärtenstr.), Venloer Str.?")]), d.streets, spelling=True).collect()
    assert sorted((r.pos, r.name, r.spelling) for r in rows) == [
        (5, "feldgaertenstrasse", "Feldgärtenstr"), (6, "venloer strasse", "Venloer Str")]


def test_area_and_display(spark):
    d = dims(spark)
    req = spark.createDataFrame([
        ("q", CITY, [("stadtteil", "403")], None), ("d", CITY, [("bezirk", "5"), ("stadtteil", "999")], None),
        ("p", CITY, [], "50823"), ("u", CITY, [], "12345")],
        "request_id string, city string, places array<struct<type:string,key:string>>, plz string")
    got = {}
    for r in P.expand_area(req, d).collect():
        got.setdefault(r.request_id, set()).add((r.type, r.key))
    assert got == {"q": {("stadtteil", "403"), ("plz", "50827")},
                   "d": {("bezirk", "5"), ("stadtteil", "501"), ("stadtteil", "502"), ("plz", "50735")},
                   "p": {("plz", "50823"), ("stadtteil", "401"), ("stadtteil", "402")}, "u": {("plz", "12345")}}
    pl = spark.createDataFrame([(CITY, "r", "stadtteil", "401", "betreff"), (CITY, "r", "stadtteil", "401", "strasse"),
                                (CITY, "r", "bezirk", "4", "betreff"), (CITY, "r", "bezirk", "5", "gremium"), (CITY, "r", "plz", "50823", "oparl")],
                               "city string, id string, type string, key string, provenance string")
    shown = sorted(tuple(r) for r in P.place_display(pl, d).select("rank", "name", "provenances").collect())
    assert shown == [(1, "Ehrenfeld", ["betreff", "strasse"]), (2, "Stadtbezirk Nippes", ["gremium"]), (3, "PLZ 50823", ["oparl"])]


def test_structured_and_checks(spark):
    d = dims(spark)
    loc = spark.createDataFrame([(CITY, "x", "plz", "50823"), (CITY, "x", "plz", "11111"), (CITY, "x", "stadtteil_name", "Altstadt")],
                                "city string, id string, type string, value string")
    assert {(r.type, r.key, r.provenance) for r in P.structured_places(loc, d).collect()} == {
        ("plz", "50823", "oparl"), ("stadtteil", "502", "oparl"), ("bezirk", "5", "oparl")}
    assert dimension_errors(d).count() == 0


def test_shown_places_read_the_places_once(spark):
    d = dims(spark)
    pl = spark.createDataFrame([(CITY, "r", "stadtteil", "999", "betreff"), (CITY, "r", "bezirk", "4", "betreff"), (CITY, "s", "stadtteil", "401", "betreff"), (CITY, "s", "bezirk", "4", "oparl")],
                               "city string, id string, type string, key string, provenance string")
    reads = spark.sparkContext.accumulator(0)

    def noted(rows):
        for r in rows:
            reads.add(1)
            yield r

    out = P.place_display(spark.createDataFrame(pl.rdd.mapPartitions(noted), pl.schema), d)
    assert sorted((r.id, r.rank, r.name) for r in out.collect()) == [("r", 2, "Stadtbezirk Ehrenfeld"), ("s", 1, "Ehrenfeld")]
    assert reads.value == 4
