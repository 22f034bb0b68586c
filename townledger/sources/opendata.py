"""Open-data catalogue and table rows: choose datasets, check licences, map rows of any shape.

Catalogue rows keep their JSON: position, dataset (raw JSON). Table rows are
dataset_id, number, cells array<struct<name,value>> in column order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.text import _c, blank, collapse_ws, norm, tokens
from ..operators.terms import words_with
from ..operators.topk import first_per_key
from ..session import cut_lineage, small_side
from .council import as_list, is_object

UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
SHOWN_FIELDS = 8
MAX_TEXT = 600
# Licence markers in comparison form; attribution is tested before public domain.
# A bare 'by 2 0' of another licence family is not accepted, only together with the German family's mark.
LICENCE_BY = ("dl de by", "dl by de", "namensnennung")
LICENCE_ZERO = ("dl de zero", "dl zero de", "cc0", "zero 2 0")
LICENCE_TEXT = {"zero": "Datenlizenz Deutschland – Zero – Version 2.0", "by": "Datenlizenz Deutschland – Namensnennung – Version 2.0"}
# Words of column names by role, most telling first.
TITLE_WORDS = ("titel", "title", "name", "bezeichnung", "massnahme", "massnahmen", "vorhaben", "objekt", "kurztext", "beschreibung",
               "zweck", "art", "strasse", "strassenname", "adresse", "standort", "ort", "lage")
DATE_WORDS = ("datum", "date", "beginn", "von", "start", "veroeffentlicht", "bekanntmachung", "aufstellungsbeschluss", "erstellt")
# A two-word pattern of the source never equals a single word of a normalised name, so only single words are kept.
END_WORDS = ("ende", "bis", "fertigstellung", "abnahme", "endezeit")
ID_WORDS = ("id", "nummer", "nr", "objektid", "objekt", "kennung", "key", "schluessel", "identifikator", "vorgangsnummer", "aktenzeichen")
DISTRIBUTION = ("identifier string, title string, license string, data struct<downloadURL:string,accessURL:string,format:string,mediaType:string,license:string>")
DATASET = "identifier string, title string, description string, modified string, license string, publisher string, distribution string"
CELLS = "array<struct<name:string,value:string>>"


def datasets(catalogue: DataFrame) -> DataFrame:
    """Catalogue rows with their fields; distributions are typed, malformed ones null."""
    d = F.from_json("dataset", DATASET)
    df = catalogue.withColumn("d", d)
    dist = F.transform(F.filter(as_list("d.distribution"), lambda r: is_object(r)), lambda r: F.from_json(r, DISTRIBUTION))
    keep = [c for c in catalogue.columns if c != "dataset"]
    return df.select(*keep, blank("d.identifier").alias("dataset_id"), collapse_ws(blank("d.title")).alias("title"), blank("d.modified").alias("modified"),
                     blank("d.license").alias("licence_field"), blank(F.get_json_object("d.publisher", "$.name")).alias("publisher"), dist.alias("distributions"))


def licence_text_of(df: DataFrame) -> Column:
    """Licence given by the dataset, else by its first distribution that gives one."""
    given = F.flatten(F.transform("distributions", lambda x: F.array(x["license"], x["data"]["license"])))
    options = F.transform(F.concat(F.array("licence_field"), given), lambda v: F.trim(blank(v)))
    return F.coalesce(F.get(F.filter(options, lambda v: v != ""), 0), F.lit(""))


def licence_kind(c) -> Column:
    """'by', 'zero' or null for anything that is not an accepted open licence."""
    n = norm(c)

    def any_of(marks):
        out = F.lit(False)
        for m in marks:
            out = out | F.contains(n, F.lit(m))
        return out

    return F.when(any_of(LICENCE_BY), "by").when(any_of(LICENCE_ZERO), "zero")


def classify_licence(ds: DataFrame, city_label: str = "Stadt Köln") -> DataFrame:
    """Licence kind and display text; attribution names the publisher."""
    df = ds.withColumn("licence", licence_text_of(ds)).withColumn("licence_kind", licence_kind("licence"))
    credit = F.coalesce(F.nullif(F.trim("publisher"), F.lit("")), F.lit(city_label))
    text = (F.when(F.col("licence_kind") == "by", F.concat(F.lit(LICENCE_TEXT["by"] + " (Namensnennung: "), credit, F.lit(")")))
            .when(F.col("licence_kind") == "zero", LICENCE_TEXT["zero"]).otherwise(""))
    return df.withColumn("licence_text", text)


def select_datasets(catalogue: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One dataset per wanted entry, each id once; counters of catalogue look-ups, fuzzy hits and misses.

    catalogue: position, dataset_id, title (per source); wanted: source_id, entry_no, entry. An id matches
    exactly; else the first title with the phrase; else the first title sharing a word of four letters.

    Titles are looked up through an index of their words that keeps the first title of each word. A phrase of several words
    meets only the titles with a word around its rarest piece.
    """
    w = wanted.withColumn("_id", F.trim("entry").rlike(UUID)).withColumn("_n", norm("entry"))
    entries = w.select("source_id", "entry_no", "entry", "_id", "_n")
    c = catalogue.select("source_id", F.struct("position", "dataset_id", "title").alias("hit"), norm("title").alias("_tn"))
    by_id = c.groupBy("source_id", F.lower("hit.dataset_id").alias("key")).agg(F.min("hit").alias("hit"))
    same_id = entries.filter("_id").withColumn("key", F.lower(F.trim("entry"))).join(by_id, ["source_id", "key"]).select("source_id", "entry_no", F.lit(0).alias("kind"), "hit")

    titled = c.select("source_id", "hit", "_tn", F.explode(F.array_distinct(tokens("_tn"))).alias("word"))
    index = cut_lineage(titled.groupBy("source_id", "word").agg(F.min("hit").alias("hit"), F.count(F.lit(1)).alias("n")))
    phrases = entries.filter("NOT _id AND _n <> ''").select("source_id", "entry_no", "_n", F.split("_n", " ").alias("pieces"))
    shared = (phrases.select("source_id", "entry_no", F.explode(F.array_distinct(F.filter("pieces", lambda x: F.length(x) >= 4))).alias("word"))
              .join(index.select("source_id", "word", "hit"), ["source_id", "word"]).select("source_id", "entry_no", F.lit(2).alias("kind"), "hit"))

    pieces = phrases.select("source_id", "_n", F.explode(F.array_distinct("pieces")).alias("piece")).distinct()
    around = cut_lineage(words_with(index, pieces).join(pieces.select("source_id", "piece").distinct(), ["source_id", "piece"]))
    single = (phrases.filter(F.size("pieces") == 1).join(around.select("source_id", F.col("piece").alias("_n"), "hit"), ["source_id", "_n"])
              .select("source_id", "entry_no", F.lit(1).alias("kind"), "hit"))
    # every piece of a phrase lies in a word of the title; the piece with the fewest titles leads to them
    several = pieces.join(phrases.filter(F.size("pieces") > 1).select("source_id", "_n").distinct(), ["source_id", "_n"])
    cost = around.groupBy("source_id", "piece").agg(F.sum("n").alias("cost"))
    rarest = several.join(cost, ["source_id", "piece"], "left").groupBy("source_id", "_n").agg(F.min(F.struct(F.coalesce("cost", F.lit(0)).alias("cost"), "piece")).alias("r"))
    leads = rarest.filter("r.cost > 0").select("source_id", "_n", F.col("r.piece").alias("piece")).join(around.select("source_id", "piece", "word"), ["source_id", "piece"])
    held = (leads.join(titled, ["source_id", "word"]).filter(F.contains("_tn", F.col("_n"))).groupBy("source_id", "_n").agg(F.min("hit").alias("hit")))
    phrase = phrases.join(held, ["source_id", "_n"]).select("source_id", "entry_no", F.lit(1).alias("kind"), "hit")

    hits = same_id.unionByName(single).unionByName(phrase).unionByName(shared)
    best = cut_lineage(hits.groupBy("source_id", "entry_no").agg(F.min(F.struct("kind", "hit")).alias("b")).select("source_id", "entry_no", "b.kind", "b.hit.*"))
    chosen = first_per_key(best.filter("dataset_id <> ''"), ["source_id", "dataset_id"], [F.col("entry_no")])
    found = best.select("source_id", "entry_no", "kind")
    counters = (wanted.join(found, ["source_id", "entry_no"], "left").groupBy("source_id")
                .agg(F.count(F.lit(1)).alias("looked_up"), F.count_if(F.col("kind") == 2).alias("fuzzy"), F.count_if(F.col("kind").isNull()).alias("not_found")))
    return chosen.select("source_id", "entry_no", "dataset_id", "title", "kind"), counters


def tabular_distributions(ds: DataFrame) -> DataFrame:
    """Distributions that are tables, with their position."""
    each = ds.select("dataset_id", F.posexplode("distributions").alias("index", "x"))
    kind = norm(F.concat_ws(" ", F.col("x.data.format"), F.col("x.data.mediaType")))
    url = F.coalesce(F.nullif(F.col("x.data.downloadURL"), F.lit("")), F.col("x.data.accessURL"), F.lit(""))
    table = F.contains(kind, F.lit("csv")) | F.contains(kind, F.lit("tsv")) | F.contains(kind, F.lit("tab")) | F.lower(url).rlike(r"\.(csv|tsv|txt)$")
    return each.filter(table).select("dataset_id", "index", blank("x.data.downloadURL").alias("download_url"), blank("x.data.accessURL").alias("access_url"))


def original_urls(tables: DataFrame) -> DataFrame:
    """First https address over the tables of a dataset, download before access."""
    options = F.filter(F.array("download_url", "access_url"), lambda u: F.startswith(u, F.lit("https://")))
    each = tables.select("dataset_id", "index", F.get(options, 0).alias("u")).filter("u is not null")
    return each.groupBy("dataset_id").agg(F.min_by("u", "index").alias("original_url"))


def _results(answers: DataFrame) -> DataFrame:
    """Answers with the names of their schema (_f) and their raw rows (_r)."""
    results = as_list(F.get_json_object("body", "$.results"))
    first_schema = F.get(F.map_values(F.from_json(F.get_json_object("body", "$.schema"), "map<string,string>")), 0)
    fields = F.coalesce(F.json_object_keys(F.get_json_object(first_schema, "$.fields")), F.array().cast("array<string>"))
    count = F.get_json_object("body", "$.count").try_cast("int")
    return answers.select("dataset_id", "index", "page_no", count.alias("announced"), fields.alias("_f"), results.alias("_r"))


def row_shapes(answers: DataFrame) -> DataFrame:
    """How many rows each answer has and the distinct lists of their column names as JSON, worked out once without the values."""
    def names(raw: Column) -> Column:
        return F.to_json(F.when(is_object(raw), F.json_object_keys(raw)).otherwise(
            F.slice("_f", F.lit(1), F.least(F.size("_f"), F.json_array_length(raw)))))

    df = _results(answers)
    return cut_lineage(df.select("dataset_id", "index", "page_no", F.size("_r").alias("_n"), F.array_distinct(F.transform("_r", names)).alias("_shapes")))


def row_names(shapes: DataFrame) -> DataFrame:
    """Distinct lists of column names of all answers."""
    listed = shapes.select(F.explode("_shapes").alias("names")).filter("names IS NOT NULL").distinct()
    return listed.select(F.from_json("names", "array<string>").alias("_names"))


def open_data_rows(answers: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """Rows of landed answers (dataset_id, index, page_no, body): objects, or value lists with the schema's names.

    Numbering runs over the whole table in page order, so it does not depend on how it was loaded. ``shapes`` may give the numbers of
    rows, see ``row_shapes``.
    """
    df = _results(answers)
    # Only page sizes are summed in order; the rows themselves stay where they are.
    key = ["dataset_id", "index", "page_no"]
    sizes = cut_lineage(df.select(*key, F.size("_r").alias("_n"))) if shapes is None else shapes
    earlier = Window.partitionBy("dataset_id", "index").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*key, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    df = df.join(small_side(starts), key).select("dataset_id", "index", "announced", "_f", "_start", F.posexplode("_r").alias("pos", "raw"))
    from_object = F.transform(F.map_entries(F.from_json("raw", "map<string,string>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    listed = F.from_json("raw", "array<string>")
    from_list = F.transform(F.arrays_zip(F.slice("_f", F.lit(1), F.least(F.size("_f"), F.size(listed))), F.slice(listed, F.lit(1), F.least(F.size("_f"), F.size(listed)))),
                            lambda z: F.struct(z["0"].alias("name"), z["1"].alias("value")))
    cells = F.when(is_object(F.col("raw")), from_object).otherwise(from_list)
    # A filter on the cells would parse every row a second time; a list that may be empty is worked out once.
    parsed = F.filter(F.array(cells.cast(CELLS)), lambda c: c.isNotNull())
    return df.select("dataset_id", "index", (F.col("_start") + F.col("pos") + 1).cast("long").alias("number"), "announced", F.explode(parsed).alias("cells"))


def cell_text(value: Column) -> Column:
    """Display text of a raw JSON value: nested values are blank, booleans are words."""
    v = blank(value)
    return (F.when(F.startswith(v, F.lit("{")) | F.startswith(v, F.lit("[")), "").when(v == "true", "ja").when(v == "false", "nein")
            .otherwise(collapse_ws(v)))


def with_column_roles(rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Cells with their display text and the roles their names can play.

    Names are looked at once per distinct list of columns, not once per row. ``names`` may give these lists, see ``row_names``; else
    the rows are read for them first.
    """
    named = rows.withColumn("_names", F.transform("cells", lambda c: c["name"])).filter("cells IS NOT NULL")
    marks = {"_t": TITLE_WORDS, "_d": DATE_WORDS, "_e": END_WORDS, "_i": ID_WORDS}

    def role(words: Column, listed) -> Column:
        return F.transform(words, lambda w: F.arrays_overlap(w, F.array(*[F.lit(m) for m in listed])))

    words = F.transform("_names", lambda n: F.split(norm(n), " "))
    lists = named.select("_names").distinct() if names is None else names
    shapes = lists.withColumn("_w", words).select("_names", *[role(F.col("_w"), m).alias(c) for c, m in marks.items()])
    # a list that was not given is looked at in its row
    joined = named.join(small_side(shapes), "_names", "left").withColumns({c: F.coalesce(c, role(words, m)) for c, m in marks.items()})
    cells = F.transform("cells", lambda c, i: F.struct(c["name"].alias("name"), cell_text(c["value"]).alias("value"), F.get("_t", i).alias("t"),
                                                       F.get("_d", i).alias("d"), F.get("_e", i).alias("e"), F.get("_i", i).alias("i")))
    return joined.withColumn("_all", cells).drop("_names", "_t", "_d", "_e", "_i")


def column_with(cells: Column, role: str) -> Column:
    """The first cell, in column order, whose column can play the role; a name has its role wherever it stands."""
    return F.get(F.filter(cells, lambda c: c[role]), 0)


def value_of(cell: Column) -> Column:
    return F.coalesce(cell["value"], F.lit(""))


def announced_gaps(answers: DataFrame) -> DataFrame:
    """Answers that bring another number of rows than they announce: dataset_id, index, page_no, announced, read."""
    read = F.coalesce(F.size(as_list(F.get_json_object("body", "$.results"))), F.lit(0))
    df = answers.select("dataset_id", "index", "page_no", F.get_json_object("body", "$.count").try_cast("int").alias("announced"), read.alias("read"))
    return df.filter("announced is not null AND announced <> read")


def row_key(cells: Column, id_value: Column) -> Column:
    """Stable key of a row: its whole id, else a hash over all fields sorted by name, each with its length in front."""
    def part(x):
        return F.concat(F.length(x).cast("string"), F.lit(":"), x)

    fields = F.sort_array(F.transform(cells, lambda c: F.struct(c["name"].alias("name"), c["value"].alias("value"))))
    hashed = F.concat(F.lit("z"), F.sha2(F.array_join(F.transform(fields, lambda c: F.concat(part(c["name"]), part(c["value"]))), "").cast("binary"), 256))
    return F.when(id_value != "", F.regexp_replace(id_value, r"\s+", "-")).otherwise(hashed)


def dataset_rows_to_entries(rows: DataFrame, meta: DataFrame, today, city_label: str = "Stadt Köln", names: DataFrame | None = None) -> DataFrame:
    """Rows of any shape as list entries; ``meta``: dataset_id, title, modified, licence_text, original_url; ``names`` as in ``with_column_roles``."""
    df = with_column_roles(rows, names).join(meta, "dataset_id").withColumn("_c", F.filter("_all", lambda c: c["value"] != ""))
    df = (df.withColumn("_tc", column_with(F.col("_c"), "t")).withColumn("_dc", column_with(F.col("_c"), "d"))
          .withColumn("_ic", column_with(F.col("_c"), "i")))
    rest = F.filter("_c", lambda c: ~c["name"].eqNullSafe(F.col("_dc.name")))
    df = df.withColumn("_ec", column_with(rest, "e"))
    name = F.coalesce(F.nullif("title", F.lit("")), F.col("dataset_id"))
    title = F.coalesce(F.nullif(value_of(F.col("_tc")), F.lit("")), F.concat(name, F.lit(" – Zeile "), F.col("number").cast("string")))
    begin, end = parse_date(value_of(F.col("_dc"))), parse_date(value_of(F.col("_ec")))
    fields = F.slice(F.filter("_c", lambda c: ~c["name"].eqNullSafe(F.col("_tc.name")) & ~c["name"].eqNullSafe(F.col("_ic.name"))), 1, SHOWN_FIELDS)
    shown = F.array_join(F.transform(fields, lambda c: F.concat(F.replace(c["name"], F.lit("_"), F.lit(" ")), F.lit(": "), c["value"])), " · ")
    reference = value_of(F.col("_ic"))
    df = df.withColumn("_b", begin).withColumn("_e", end).withColumn("_n", name).withColumn("_ref", reference)
    span = F.concat_ws(" – ", F.nullif("_b", F.lit("")), F.nullif("_e", F.lit("")))
    changed = F.substring(blank("modified"), 1, 10)
    told = F.concat_ws(" ", F.concat(F.lit("Zeile aus dem Datensatz „"), F.col("_n"), F.lit("“ (Nummer "), F.col("number").cast("string"), F.lit(").")),
                       F.when(span != "", F.concat(F.lit("Zeitraum: "), span, F.lit("."))),
                       F.when(changed != "", F.concat(F.lit("Datensatz vom "), changed, F.lit("."))),
                       F.when(blank("licence_text") != "", F.concat(F.lit("Lizenz: "), F.col("licence_text"), F.lit("."))))
    note = F.trim(F.concat(F.lit("Angabe aus offenen Daten, nicht amtlich. "), blank("licence_text")))
    return df.select("dataset_id", F.concat_ws(":", F.lit("opendata"), F.col("dataset_id"), row_key(F.col("_all"), F.col("_ref"))).alias("id"),
                     F.concat(F.lit("Datensatz: "), F.substring("_n", 1, 120)).alias("kind"), title.alias("title"), F.col("_ref").alias("reference"),
                     F.col("_b").alias("date"), blank("original_url").alias("web"), F.col("_n").alias("category"), F.lit("").alias("step"),
                     F.lit("Zeile eines Datensatzes").alias("short_status"), told.alias("status_text"),
                     ((F.col("_e") != "") & (F.col("_e") >= F.lit(today))).alias("open"), F.substring(shown, 1, MAX_TEXT).alias("short_text"), note.alias("extra"),
                     F.col("_e").alias("deadline"), F.array_join(F.transform("_all", lambda c: c["value"]), " ").alias("hidden_text"))


def column_roles(columns: DataFrame, name: str = "name") -> DataFrame:
    """Role of a column by the words of its name, for a table of column names."""
    words = F.split(norm(_c(name)), " ")

    def hit(marks):
        return F.arrays_overlap(words, F.array(*[F.lit(m) for m in marks]))

    return (columns.withColumn("is_title", hit(TITLE_WORDS)).withColumn("is_date", hit(DATE_WORDS)).withColumn("is_end", hit(END_WORDS))
            .withColumn("is_id", hit(ID_WORDS)))
