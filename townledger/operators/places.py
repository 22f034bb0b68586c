"""Place annotation: gazetteer phrases, district numbers, postcodes and street names found in text.

Texts are frames with ``city, id, part, text, provenance, districts_only``; ``part`` tells apart
several texts of one record. The result is ``city, id, type, key, provenance``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _c, blank, collapse_ws, norm, raw_words, street_key, street_key_of_norm, tokens
from ..session import BROADCAST_ROWS, settled, small_side
from .dims import CityDims
from .names import NameFilter

SHORT_NAME = 4  # one-word names up to this length count only when written with a capital
FEW_NAMES = 512  # up to here the names travel inside the expression
FEW_PHRASES = 64  # up to here names of several words are searched in the text, beyond that its word runs are listed
STREET_MIN = 6  # shortest one-word street name that is told apart from everyday words
QUARTER, DISTRICT, POSTCODE = "stadtteil", "bezirk", "plz"
NOT_WORD = r"[\p{L}\p{N}_]"
DISTRICT_NUMBER = rf"(?iu)(?<!{NOT_WORD})bezirk(?:svertretung)?[\s\x{{a0}}]*(\d{{1,2}})(?!{NOT_WORD})"
POSTCODE_TEXT = r"(?<!\d)(\d{5})(?!\d)"
CAPITALISED = rf"(?<!{NOT_WORD})(\p{{Lu}}{NOT_WORD}*)"
TEXT_KEY = ["city", "id", "part"]


def build_gazetteer(dims: CityDims) -> DataFrame:
    """Names and aliases of districts and quarters in comparison form."""
    def named(df, kind):
        names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
        return (df.select("city", F.lit(kind).alias("type"), F.col("nr").cast("string").alias("key"),
                          F.explode(names).alias("name"))
                .select("city", norm("name").alias("phrase"), "type", "key"))

    both = named(dims.districts, DISTRICT).unionByName(named(dims.quarters, QUARTER))
    return both.filter("phrase <> ''").distinct().withColumn("n_tokens", F.size(F.split("phrase", " ")))


def lookup_table(gazetteer: DataFrame, dims: CityDims) -> DataFrame:
    """Everything a text can name, keyed by (kind, value); a quarter also stands for its district."""
    plain = gazetteer.select("city", F.lit("phrase").alias("kind"), F.col("phrase").alias("value"), "type", "key",
                             (F.col("type") == QUARTER).alias("of_quarter"))
    parent = dims.quarters.select("city", F.col("nr").cast("string").alias("key"),
                                  F.col("district").cast("string").alias("district"))
    rolled = (plain.filter(F.col("type") == QUARTER).join(parent, ["city", "key"])
              .select("city", "kind", "value", F.lit(DISTRICT).alias("type"), F.col("district").alias("key"),
                      F.lit(True).alias("of_quarter")))
    numbers = dims.districts.select("city", F.lit("number").alias("kind"), F.col("nr").cast("string").alias("value"),
                                    F.lit(DISTRICT).alias("type"), F.col("nr").cast("string").alias("key"),
                                    F.lit(False).alias("of_quarter"))
    postcodes = dims.postcodes.select("city", F.lit("postcode").alias("kind"), F.col("plz").alias("value"),
                                      F.lit(POSTCODE).alias("type"), F.col("plz").alias("key"),
                                      F.lit(True).alias("of_quarter"))
    return plain.unionByName(rolled).unionByName(numbers).unionByName(postcodes).distinct()


def ngrams(toks: Column, n: int) -> Column:
    """All runs of ``n`` words."""
    if n == 1:
        return toks
    runs = F.transform(F.sequence(F.lit(0), F.size(toks) - n), lambda i: F.concat_ws(" ", *[F.get(toks, i + k) for k in range(n)]))
    return F.when(F.size(toks) >= n, runs).otherwise(F.array().cast("array<string>"))


def named_phrases(text, toks: Column, lengths) -> Column:
    """Distinct word runs of a text that may be place names; short names need a capital in the text."""
    runs = [F.filter(toks, lambda w: F.length(w) > SHORT_NAME)] if 1 in lengths else []
    runs += [ngrams(toks, n) for n in lengths if n > 1]
    return F.array_distinct(F.concat(F.array_intersect(capital_forms(text), toks), *runs))


def capital_forms(text, names: list[str] | None = None) -> Column:
    """Comparison forms of the short words that a text writes with a capital; of plain words only those among ``names``."""
    def plain(w):
        short = F.length(w) <= SHORT_NAME
        return short if names is None else short & (F.lower(w).isin(*names) | F.contains(w, F.lit("_")))

    written = F.regexp_extract_all(_c(text), F.lit(CAPITALISED), F.lit(1))
    brief = F.filter(written, lambda w: plain(w) | (F.octet_length(w) > F.length(w)))
    return F.filter(F.transform(brief, norm), lambda w: F.length(w) <= SHORT_NAME)


def listed_phrases(text, normed: Column, toks: Column, names: list[str]) -> Column:
    """Those of a handful of names that a text holds, by the rule of ``named_phrases``; its other words never leave the row."""
    def listed(values):
        return F.array(*[F.lit(v) for v in values])

    short = [n for n in names if " " not in n and len(n) <= SHORT_NAME]
    long = [n for n in names if " " not in n and len(n) > SHORT_NAME]
    several = [n for n in names if " " in n]
    parts = [F.array().cast("array<string>")]
    if short:
        parts.append(F.array_intersect(F.array_intersect(capital_forms(text, short), listed(short)), toks))
    if long:
        parts.append(F.array_intersect(toks, listed(long)))
    if several and len(several) <= FEW_PHRASES:
        padded = F.concat(F.lit(" "), normed, F.lit(" "))
        parts.append(F.array_compact(F.array(*[F.when(F.contains(padded, F.lit(f" {n} ")), F.lit(n)) for n in several])))
    elif several:
        for k in sorted({n.count(" ") + 1 for n in several}):
            parts.append(F.array_intersect(ngrams(toks, k), listed([n for n in several if n.count(" ") + 1 == k])))
    return F.concat(*parts)


def _lengths(df: DataFrame, col: str) -> list[int]:
    """The few distinct name lengths of a dimension."""
    return sorted(r[0] for r in df.select(F.size(F.split(col, " ")).alias("n")).distinct().collect())


def text_hits(texts: DataFrame, gazetteer: DataFrame, dims: CityDims, few: int = FEW_NAMES) -> DataFrame:
    """One row per text and named place: a single explode and one equi join on (city, kind, value).

    Up to ``few`` names are compared inside the row; with more, all word runs that may be a name meet the names in the join.
    """
    names = [r.phrase for r in gazetteer.select("phrase").distinct().limit(few + 1).collect()]
    table = small_side(lookup_table(gazetteer, dims))
    toks = texts.withColumn("_norm", norm("text")).withColumn("_toks", tokens("_norm"))
    if len(names) <= few:
        phrases = listed_phrases("text", F.col("_norm"), F.col("_toks"), sorted(names))
    else:
        phrases = named_phrases("text", F.col("_toks"), _lengths(gazetteer, "phrase"))

    def keyed(kind, values):
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    numbers = F.regexp_extract_all("text", F.lit(DISTRICT_NUMBER), F.lit(1))
    numbers = F.when(F.contains("_norm", F.lit("bez")), numbers).otherwise(F.array().cast("array<string>"))
    named = F.concat(
        keyed("phrase", phrases),
        keyed("number", F.array_distinct(numbers)),
        keyed("postcode", F.array_distinct(F.regexp_extract_all("text", F.lit(POSTCODE_TEXT), F.lit(1)))))
    return (toks.select(*TEXT_KEY, "provenance", "districts_only", F.explode(named).alias("m"))
            .select(*TEXT_KEY, "provenance", "districts_only", "m.kind", "m.value")
            .join(table, ["city", "kind", "value"])
            .filter(~(F.col("districts_only") & F.col("of_quarter")))
            .select(*TEXT_KEY, "provenance", "kind", "value", "type", "key"))


def street_candidates(toks: Column, lengths) -> Column:
    """Positions of all word runs long enough to be a street name."""
    empty = F.array().cast("array<struct<pos:int,len:int,name:string>>")
    parts = []
    for n in lengths:
        runs = F.transform(ngrams(toks, n), lambda g, i: F.struct((i + 1).cast("int").alias("pos"),
                                                                 F.lit(n).alias("len"), g.alias("name")))
        parts.append(F.filter(runs, lambda s: F.length(s["name"]) >= STREET_MIN) if n == 1 else runs)
    return F.concat(empty, *parts)


def leftmost_longest(found: Column) -> Column:
    """Greedy choice over hits sorted by position and falling length; used words are not used again."""
    kind = "array<struct<pos:int,neg:int,len:int,name:string>>"
    zero = F.struct(F.lit(1).alias("free"), F.array().cast(kind).alias("kept"))

    def step(acc, hit):
        kept = F.struct((hit["pos"] + hit["len"]).alias("free"), F.concat(acc["kept"], F.array(hit)).alias("kept"))
        return F.when(hit["pos"] >= acc["free"], kept).otherwise(acc)

    return F.aggregate(found, zero, step, lambda acc: acc["kept"])


def match_streets(texts: DataFrame, streets: DataFrame, spelling: bool = False, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Street names of each text, left to right, longest first; optionally as the text writes them.

    A register of up to ``rows`` names is sent to all tasks. With a larger one a Bloom filter of its names drops the word runs
    that are no name where they arise, so that the shuffle of the exact join carries little more than the hits.
    """
    lengths = _lengths(streets, "name") or [1]
    names = streets.select("city", "name").distinct()
    df = texts.withColumn("_toks", tokens(street_key("text")))
    runs = (df.select(*TEXT_KEY, "provenance", F.explode(street_candidates(F.col("_toks"), lengths)).alias("c"))
            .select(*TEXT_KEY, "provenance", "c.pos", "c.len", "c.name"))
    by_name = settled(names, rows)
    if by_name is names:
        hits = NameFilter(names, ["city", "name"]).keep(runs).join(names, ["city", "name"])
    else:
        hits = runs.join(F.broadcast(by_name), ["city", "name"])
    chosen = (hits.groupBy(*TEXT_KEY, "provenance")
              .agg(F.array_sort(F.collect_set(F.struct("pos", (-F.col("len")).alias("neg"), "len", "name"))).alias("found"))
              .select(*TEXT_KEY, "provenance", F.explode(leftmost_longest(F.col("found"))).alias("h"))
              .select(*TEXT_KEY, "provenance", "h.pos", "h.len", "h.name"))
    if not spelling:
        return chosen
    words = F.filter(F.split(collapse_ws("text"), " "), lambda w: w != "")
    origin = F.flatten(F.transform(words, lambda w, i: F.transform(tokens(street_key(w)), lambda t: i + 1)))
    shown = F.array_join(F.slice("_w", F.col("_from"), F.col("_to") - F.col("_from") + 1), " ")
    return (chosen.join(texts.select(*TEXT_KEY, words.alias("_w"), origin.alias("_o")), TEXT_KEY)
            .withColumn("_from", F.element_at("_o", F.col("pos")))
            .withColumn("_to", F.element_at("_o", F.col("pos") + F.col("len") - 1))
            .select(*TEXT_KEY, "provenance", "pos", "len", "name",
                    F.trim(shown, F.lit(" .,;:!?()[]")).alias("spelling")))


def unambiguous_streets(streets: DataFrame, dims: CityDims) -> DataFrame:
    """Streets of exactly one quarter, with the quarter and its district as places."""
    parent = dims.quarters.select("city", F.col("nr").cast("string").alias("quarter"),
                                  F.col("district").cast("string").alias("district"))
    one = (streets.filter(F.size("quarters") == 1)
           .select("city", "name", F.col("quarters")[0]["quarter"].alias("quarter"))
           .join(parent, ["city", "quarter"], "left"))
    places = F.array(F.struct(F.lit(QUARTER).alias("type"), F.col("quarter").alias("key")),
                     F.struct(F.lit(DISTRICT).alias("type"), F.col("district").alias("key")))
    return one.select("city", "name", F.explode(places).alias("p")).select("city", "name", "p.type", "p.key").filter("key is not null")


def match_places(texts: DataFrame, dims: CityDims) -> DataFrame:
    """All places named by the texts; streets of one quarter add it unless the text names it anyway."""
    gazetteer = build_gazetteer(dims)
    hits = text_hits(texts, gazetteer, dims)
    if dims.streets is None:
        return hits.select("city", "id", "type", "key", "provenance").distinct()
    free = texts.filter(~F.col("districts_only"))
    from_street = (match_streets(free, dims.streets)
                   .join(small_side(unambiguous_streets(dims.streets, dims)), ["city", "name"])
                   .select(*TEXT_KEY, "provenance", F.lit("street").alias("kind"), F.col("name").alias("value"), "type", "key"))
    seen = (hits.unionByName(from_street).groupBy(*TEXT_KEY, "provenance", "type", "key")
            .agg(F.max(F.col("kind") == "phrase").alias("named"),
                 F.max(F.col("kind") == "street").alias("street"),
                 F.max(F.col("kind").isin("number", "postcode")).alias("other")))
    sources = F.array_compact(F.array(F.when(F.col("named") | F.col("other"), F.col("provenance")),
                                      F.when(F.col("street") & ~F.col("named"), F.lit("strasse"))))
    return seen.select("city", "id", "type", "key", F.explode(sources).alias("provenance")).distinct()


def structured_places(locations: DataFrame, dims: CityDims) -> DataFrame:
    """Places given as fields: known postcodes, and quarters by name with their district.

    ``locations`` is city, id, type ('plz' or 'stadtteil_name'), value.
    """
    known = dims.postcodes.select("city", F.col("plz").alias("value"))
    plz = (locations.filter(F.col("type") == POSTCODE).join(small_side(known), ["city", "value"])
           .select("city", "id", F.lit(POSTCODE).alias("type"), F.col("value").alias("key")))
    first_quarter = (build_gazetteer(dims).filter(F.col("type") == QUARTER)
                     .groupBy("city", "phrase").agg(F.min("key").alias("quarter")))
    parent = dims.quarters.select("city", F.col("nr").cast("string").alias("quarter"),
                                  F.col("district").cast("string").alias("district"))
    named = (locations.filter(F.col("type") == "stadtteil_name").withColumn("phrase", norm("value"))
             .join(small_side(first_quarter.join(parent, ["city", "quarter"])), ["city", "phrase"]))
    both = F.array(F.struct(F.lit(QUARTER).alias("type"), F.col("quarter").alias("key")),
                   F.struct(F.lit(DISTRICT).alias("type"), F.col("district").alias("key")))
    quarters = named.select("city", "id", F.explode(both).alias("p")).select("city", "id", "p.type", "p.key")
    return plz.unionByName(quarters).withColumn("provenance", F.lit("oparl")).distinct()


def texts_of(df: DataFrame, *parts: tuple) -> DataFrame:
    """Texts of a frame with city and id: each part is (column, provenance[, districts_only])."""
    rows = F.array(*[F.struct(F.lit(i).alias("part"), blank(p[0]).alias("text"), F.lit(p[1]).alias("provenance"),
                              F.lit(bool(p[2]) if len(p) > 2 else False).alias("districts_only"))
                     for i, p in enumerate(parts)])
    return df.select("city", "id", F.explode(rows).alias("t")).select("city", "id", "t.*").filter("text <> ''")


def expand_area(requests: DataFrame, dims: CityDims) -> DataFrame:
    """Area of each request: postcode to quarters, district to quarters, quarter to postcodes.

    A quarter never widens to its district nor to the other quarters of its postcode. Unknown
    districts and quarters are dropped, an unknown postcode stays.
    """
    q = small_side(dims.quarters.select("city", F.col("nr").cast("string").alias("key"),
                                        F.col("district").cast("string").alias("district")))
    d = small_side(dims.districts.select("city", F.col("nr").cast("string").alias("key")))
    pq = small_side(dims.postcode_quarters.select("city", "plz", F.col("quarter").cast("string").alias("key")).distinct())
    asked = (requests.select("request_id", "city", F.explode("places").alias("p"))
             .select("request_id", "city", F.col("p.type").alias("type"), F.col("p.key").alias("key")))
    plz = requests.filter(F.coalesce("plz", F.lit("")) != "").select("request_id", "city", "plz")
    districts = asked.filter(F.col("type") == DISTRICT).join(d, ["city", "key"])
    quarters = (asked.filter(F.col("type") == QUARTER).join(q, ["city", "key"]).select("request_id", "city", "key")
                .unionByName(plz.join(pq, ["city", "plz"]).select("request_id", "city", "key"))
                .unionByName(districts.select("request_id", "city", F.col("key").alias("district"))
                             .join(q, ["city", "district"]).select("request_id", "city", "key"))
                .distinct())
    codes = plz.withColumnRenamed("plz", "key").unionByName(
        quarters.join(pq, ["city", "key"]).select("request_id", "city", F.col("plz").alias("key")))

    def typed(df, kind):
        return df.select("request_id", "city", F.lit(kind).alias("type"), "key")

    return typed(quarters, QUARTER).unionByName(typed(districts, DISTRICT)).unionByName(typed(codes, POSTCODE)).distinct()


def place_display(places: DataFrame, dims: CityDims) -> DataFrame:
    """Places to show per record: quarters, districts without one of their quarters, postcodes."""
    q = dims.quarters.select("city", F.lit(QUARTER).alias("type"), F.col("nr").cast("string").alias("key"), F.lit(1).alias("rank"), "name",
                             F.col("district").cast("string").alias("district"))
    has_word = F.lower("name").rlike("^(stadtbezirk|bezirk)")
    d = dims.districts.select("city", F.lit(DISTRICT).alias("type"), F.col("nr").cast("string").alias("key"), F.lit(2).alias("rank"),
                              F.when(has_word, F.col("name")).otherwise(F.concat(F.lit("Stadtbezirk "), F.col("name"))).alias("name"),
                              F.lit(None).cast("string").alias("district"))
    # The places are read once: all of a record meet in one row, whose length the dimensions bound.
    each = (places.groupBy("city", "id", "type", "key").agg(F.array_sort(F.collect_set("provenance")).alias("provenances"))
            .join(small_side(q.unionByName(d)), ["city", "type", "key"], "left"))
    plz = F.col("type") == POSTCODE
    item = F.struct(F.when(plz, 3).otherwise(F.col("rank")).alias("rank"), "type", "key",
                    F.when(plz, F.concat(F.lit("PLZ "), F.col("key"))).otherwise(F.col("name")).alias("name"), "provenances", "district")
    listed = each.filter(plz | F.col("rank").isNotNull()).groupBy("city", "id").agg(F.collect_list(item).alias("all"))
    covered = F.transform(F.filter("all", lambda x: x["type"] == QUARTER), lambda x: x["district"])
    shown = F.filter("all", lambda x: (x["type"] != DISTRICT) | ~F.exists("covered", lambda c: c.eqNullSafe(x["key"])))
    return (listed.withColumn("covered", covered).select("city", "id", F.explode(shown).alias("x"))
            .select("city", "id", *[f"x.{c}" for c in ("rank", "type", "key", "name", "provenances")]))


def council_texts(papers: DataFrame, committee_names: DataFrame) -> DataFrame:
    """Texts of council papers: the title, and each named committee for districts only."""
    titles = texts_of(papers, ("title", "betreff"))
    names = (committee_names.filter("name <> ''")
             .select("city", "id", (F.abs(F.xxhash64("name")) + 1).alias("part"), F.col("name").alias("text"),
                     F.lit("gremium").alias("provenance"), F.lit(True).alias("districts_only")).distinct())
    return titles.withColumn("part", F.col("part").cast("long")).unionByName(names)


def plan_texts(plans: DataFrame) -> DataFrame:
    return texts_of(plans, ("title", "betreff"), ("description", "beschreibung"))


def entry_texts(entries: DataFrame, *cols: str) -> DataFrame:
    """Texts of list entries: the given columns joined, with ``City-Quarter`` spelled apart."""
    from ..functions.text import strip_city_hyphen
    return texts_of(entries.withColumn("_t", strip_city_hyphen(F.concat_ws(" ", *[blank(c) for c in cols]))), ("_t", "betreff"))
