"""Small dimensions of our own, and plain-Python formulations of place rules."""

from townledger.operators.dims import CityDims, normalise_terms

CITY = "musterstadt"


def dims(spark, streets=True):
    districts = [(CITY, "4", "Ehrenfeld", []), (CITY, "5", "Nippes", ["Bezirk Nord"]), (CITY, "10", "Porz", [])]
    quarters = [(CITY, "401", "Ehrenfeld", "4", []), (CITY, "402", "Neuehrenfeld", "4", []),
                (CITY, "403", "Bickendorf", "4", []), (CITY, "501", "Niehl", "5", []),
                (CITY, "502", "Alte Stadt", "5", ["Altstadt"]), (CITY, "1001", "Eil", "10", []),
                (CITY, "1002", "Musterstadt-Mitte", "10", [])]
    postcodes = [(CITY, "50823", ""), (CITY, "50827", "Näherung"), (CITY, "50735", ""), (CITY, "50999", "leer")]
    bridge = [(CITY, "50823", "401"), (CITY, "50823", "402"), (CITY, "50827", "403"), (CITY, "50735", "501")]
    themes = [(CITY, "bauen", "Bauen", ["Bauvorhaben", "Wohnungsbau", "Bau"], 0),
              (CITY, "verkehr", "Verkehr", ["Verkehr", "Radweg"], 1)]
    cities = [(CITY, "Musterstadt", ["Muster"], False), ("nordhausen", "Nordhausen", [], True)]
    reg = [(CITY, "feldgaertenstrasse", [("501", 3)], ["50735"]), (CITY, "venloer strasse", [("401", 60), ("403", 44)], ["50823", "50827"]),
           (CITY, "am alten turm", [("403", 2)], ["50827"]), (CITY, "alten turm", [("501", 1)], []),
           (CITY, "markt", [("401", 1)], [])]
    c = spark.createDataFrame
    return CityDims(
        districts=c(districts, "city string, nr string, name string, aliases array<string>"),
        quarters=c(quarters, "city string, nr string, name string, district string, aliases array<string>"),
        postcodes=c(postcodes, "city string, plz string, note string"),
        postcode_quarters=c(bridge, "city string, plz string, quarter string"),
        themes=normalise_terms(c(themes, "city string, key string, label string, terms array<string>, pos int")),
        cities=c(cities, "city string, name string, aliases array<string>, on_demand boolean"),
        streets=c(reg, "city string, name string, quarters array<struct<quarter:string,n:int>>, postcodes array<string>")
        if streets else None)


def texts(spark, rows):
    """rows: (id, text[, provenance[, districts_only]])"""
    full = [(CITY, r[0], 0, r[1], r[2] if len(r) > 2 else "betreff", r[3] if len(r) > 3 else False) for r in rows]
    return spark.createDataFrame(full, "city string, id string, part int, text string, provenance string, districts_only boolean")
