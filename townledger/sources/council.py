"""Council objects from landed JSON: list pages, bare lists and single objects.

References may be an address or an embedded object, single or in a list. Fields are therefore read
as raw JSON text and told apart by their first character; no schema is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import file_role
from ..functions.text import blank, norm
from ..functions.urls import resolve_url
from ..operators.topk import first_per_key

# Load order: papers need the committee names, meetings come last in a full load of a source.
KINDS = {"Organization": 0, "Meeting": 1, "Paper": 2}

ORGANIZATION = "id string, name string, shortName string, organizationType string, startDate string, endDate string, web string, modified string, deleted string"
MEETING = ("id string, name string, start string, `end` string, cancelled string, location string, organization string, agendaItem string, "
           "invitation string, resultsProtocol string, verbatimProtocol string, auxiliaryFile string, web string, modified string, deleted string")
PAPER = ("id string, name string, reference string, date string, paperType string, web string, modified string, consultation string, mainFile string, "
         "auxiliaryFile string, relatedPaper string, superordinatedPaper string, subordinatedPaper string, location string, deleted string")
CONSULTATION = "id string, meeting string, agendaItem string, organization string, role string, authoritative string, modified string, deleted string"
ITEM = "id string, number string, `order` string, name string, result string, public boolean, consultation string, modified string, deleted string"
FILE = ("id string, name string, fileName string, mimeType string, date string, accessUrl string, downloadUrl string, modified string, deleted string")
LOCATION = "room string, streetAddress string, postalCode string, locality string, subLocality string"


def is_object(c) -> Column:
    return F.startswith(F.ltrim(c), F.lit("{"))


def as_list(c) -> Column:
    """Raw JSON of a field as a list: missing is empty, a single value has one element."""
    c = F.col(c) if isinstance(c, str) else c
    many = F.startswith(F.ltrim(c), F.lit("["))
    parsed = F.from_json(c, "array<string>")
    return F.when(c.isNull(), F.array().cast("array<string>")).when(many, F.coalesce(parsed, F.array().cast("array<string>"))).otherwise(F.array(c))


def ref_id(c) -> Column:
    """Identifier behind a reference: an address stays, an object gives its id, nothing is blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull(), "").when(is_object(c), F.coalesce(F.get_json_object(c, "$.id"), F.lit(""))).otherwise(c)


def normalise_refs(c) -> Column:
    """List of identifiers of a reference field."""
    return F.filter(F.transform(as_list(c), ref_id), lambda x: x != "")


def truthy(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(~c.isin("", "false", "0", "0.0", "[]", "{}"), F.lit(False))


def read_pages(spark: SparkSession, paths) -> DataFrame:
    """Landed JSON files, one page per row: url (file), body."""
    return spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("body"))


def council_objects(pages: DataFrame) -> DataFrame:
    """Objects of all pages with the last part of their type; pages: url, body (+ further columns kept)."""
    keep = [c for c in pages.columns if c != "body"]
    # one pass over the body gives the raw texts of its elements
    listed = F.from_json("body", "data array<string>")["data"]
    elements = F.when(F.startswith(F.ltrim("body"), F.lit("[")), as_list("body")).otherwise(F.coalesce(listed, F.array("body")))
    df = pages.select(*keep, F.posexplode(elements).alias("pos", "obj"))
    df = df.filter(is_object(F.col("obj")))
    return df.select(*keep, "pos", F.element_at(F.split(blank(F.get_json_object("obj", "$.type")), "/"), -1).alias("type"), "obj")


def next_links(pages: DataFrame) -> DataFrame:
    """Address of the following page per page, blank at the end."""
    nxt = F.get_json_object("body", "$.links.next")
    return pages.select("url", F.when(nxt.isNull() | (nxt == ""), "").otherwise(resolve_url(nxt, F.col("url"))).alias("next_url"))


def read_council_objects(spark: SparkSession, paths) -> DataFrame:
    objs = council_objects(read_pages(spark, paths)).filter(F.col("type").isin(*KINDS))
    rank = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return objs.withColumn("load_order", F.element_at(rank, F.col("type")))


def _delivery(objs: DataFrame) -> list[Column]:
    """Place of an object in its load: number of the page (else the last number of its address), then place on the page."""
    order = []
    if "page_no" in objs.columns:
        order.append(F.col("page_no"))
    elif "url" in objs.columns:
        order += [F.regexp_extract("url", r"(\d+)\D*$", 1).try_cast("bigint"), F.col("url")]
    return order + ([F.col("pos")] if "pos" in objs.columns else [])


def _fields(schema: str, *names: str) -> str:
    """Those fields of a schema, with id and deleted; what is not read is skipped in the text and not shuffled."""
    return ", ".join(f for f in schema.split(", ") if f.split(" ")[0] in ("id", "deleted", *names))


def _parsed(objs: DataFrame, kind: str, schema: str) -> DataFrame:
    """Objects of one kind with their fields under ``o``; the last delivery of an id counts, also if it deletes the object."""
    keep = [c for c in ("source_id", "city") if c in objs.columns]
    order = [c.alias(f"_at{i}") for i, c in enumerate(_delivery(objs))]
    df = (objs.filter(F.col("type") == kind).select(*keep, *order, F.from_json("obj", schema).alias("o"))
          .filter("o.id is not null and o.id <> ''"))
    if not order:
        return df
    last = [F.col(f"_at{i}").desc_nulls_last() for i in range(len(order))]
    return (first_per_key(df.withColumn("_id", F.col("o.id")), [*[c for c in keep if c == "source_id"], "_id"], last)
            .drop("_id", *[f"_at{i}" for i in range(len(order))]))


def live_objects(parsed: DataFrame) -> DataFrame:
    return parsed.filter(~truthy("o.deleted"))


def deleted_ids(objs: DataFrame, kind: str) -> DataFrame:
    """Ids of objects delivered as deleted."""
    schema = {"Organization": ORGANIZATION, "Meeting": MEETING, "Paper": PAPER}[kind]
    return _parsed(objs, kind, _fields(schema)).filter(truthy("o.deleted")).select(F.col("o.id").alias("id")).distinct()


def _src(df: DataFrame):
    return [c for c in ("source_id", "city") if c in df.columns]


def organizations(objs: DataFrame) -> DataFrame:
    df = live_objects(_parsed(objs, "Organization", ORGANIZATION))
    o = "o."
    return df.select(F.col("o.id").alias("id"), *_src(df), *[blank(o + a).alias(b) for a, b in (
        ("name", "name"), ("shortName", "short_name"), ("organizationType", "type"), ("startDate", "begin"), ("endDate", "end"),
        ("web", "web"), ("modified", "modified"))], F.lit(False).alias("deleted"))


def meetings(objs: DataFrame) -> DataFrame:
    df = live_objects(_parsed(objs, "Meeting", MEETING)).withColumn("l", F.from_json("o.location", LOCATION))

    def part(c):
        return F.nullif(blank(c), F.lit(""))

    town = F.nullif(F.concat_ws(" ", part("l.postalCode"), part("l.locality")), F.lit(""))
    return df.select(F.col("o.id").alias("id"), *_src(df), blank("o.name").alias("name"), blank("o.start").alias("begin"),
                     blank("o.end").alias("end"), F.substring(blank("o.start"), 1, 10).alias("date"),
                     F.concat_ws(", ", part("l.room"), part("l.streetAddress"), town).alias("place"), truthy("o.cancelled").alias("cancelled"),
                     normalise_refs("o.organization").alias("committee_ids"), blank("o.web").alias("web"), blank("o.modified").alias("modified"),
                     F.lit(False).alias("deleted"))


def agenda_items(objs: DataFrame) -> DataFrame:
    df = live_objects(_parsed(objs, "Meeting", _fields(MEETING, "agendaItem")))
    each = (df.select(F.col("o.id").alias("meeting_id"), F.explode(as_list("o.agendaItem")).alias("raw")).filter(is_object(F.col("raw")))
            .select("meeting_id", F.from_json("raw", ITEM).alias("a")).filter("a.id is not null"))
    return each.select(F.col("a.id").alias("id"), "meeting_id", blank("a.number").alias("number"),
                       F.coalesce(F.col("a.order").try_cast("int"), F.lit(0)).alias("item_order"), blank("a.name").alias("name"),
                       blank("a.result").alias("result"), ref_id("a.consultation").alias("consultation_id"),
                       F.coalesce("a.public", F.lit(True)).alias("public"), blank("a.modified").alias("modified"), truthy("a.deleted").alias("deleted"))


def papers(objs: DataFrame) -> DataFrame:
    df = live_objects(_parsed(objs, "Paper", _fields(PAPER, "reference", "name", "paperType", "date", "modified", "web")))
    return df.select(F.col("o.id").alias("id"), *_src(df), *[blank("o." + a).alias(b) for a, b in (
        ("reference", "reference"), ("name", "title"), ("paperType", "kind"), ("date", "date"), ("modified", "modified"), ("web", "web"))],
        norm(F.concat_ws(" ", blank("o.name"), blank("o.reference"), blank("o.paperType"))).alias("search_text"), F.lit(False).alias("deleted"))


def consultations(objs: DataFrame) -> DataFrame:
    """Consultation chain of papers; a bare address is an empty stub."""
    df = live_objects(_parsed(objs, "Paper", _fields(PAPER, "consultation")))
    each = df.select(F.col("o.id").alias("record_id"), F.posexplode(as_list("o.consultation")).alias("pos", "raw")).filter("raw is not null")
    each = each.withColumn("c", F.when(is_object(F.col("raw")), F.from_json("raw", CONSULTATION)))
    cid = F.when(is_object(F.col("raw")), F.col("c.id")).otherwise(F.col("raw"))
    return each.withColumn("id", cid).filter("id is not null").select(
        "id", "record_id", "pos", ref_id("c.meeting").alias("meeting_id"), ref_id("c.agendaItem").alias("agenda_item_id"),
        normalise_refs("c.organization").alias("committee_ids"), blank("c.role").alias("role"), truthy("c.authoritative").alias("authoritative"),
        blank("c.modified").alias("modified"), truthy("c.deleted").alias("deleted"))


def paper_relations(objs: DataFrame) -> DataFrame:
    kinds = (("relatedPaper", "verwandt"), ("superordinatedPaper", "uebergeordnet"), ("subordinatedPaper", "untergeordnet"))
    df = live_objects(_parsed(objs, "Paper", _fields(PAPER, *[f for f, _ in kinds])))
    edges = F.concat(*[_edges(f"o.{f}", kind) for f, kind in kinds])
    return df.select(F.col("o.id").alias("from_id"), F.explode(edges).alias("e")).select("from_id", F.col("e.to_id").alias("to_id"), F.col("e.kind").alias("kind")).distinct()


def _edges(c: str, kind: str) -> Column:
    return F.transform(normalise_refs(c), lambda t: F.struct(t.alias("to_id"), F.lit(kind).alias("kind")))


def paper_locations(objs: DataFrame) -> DataFrame:
    """Structured places of papers: city, id, type, value."""
    df = live_objects(_parsed(objs, "Paper", _fields(PAPER, "location")))
    each = (df.select(*_src(df), F.col("o.id").alias("id"), F.explode(as_list("o.location")).alias("raw")).filter(is_object(F.col("raw")))
            .withColumn("l", F.from_json("raw", LOCATION)))
    rows = F.array(F.struct(F.lit("plz").alias("type"), blank("l.postalCode").alias("value")),
                   F.struct(F.lit("stadtteil_name").alias("type"), blank("l.subLocality").alias("value")))
    return each.select(*_src(df), "id", F.explode(rows).alias("r")).select(*_src(df), "id", "r.type", "r.value").filter("value <> ''")


def file_refs(objs: DataFrame) -> DataFrame:
    """Document links of papers and meetings; per owner the first mention of a file counts."""
    def each(kind, schema, fixed, owner):
        df = live_objects(_parsed(objs, kind, _fields(schema, "auxiliaryFile", *[f for f, _ in fixed])))
        lists = [F.transform(F.filter(F.array(F.col(f"o.{f}")), lambda r: r.isNotNull()), _with_role(role)) for f, role in fixed]
        lists.append(F.transform(as_list("o.auxiliaryFile"), _with_role(None)))
        rec = F.col("o.id") if owner == "record_id" else F.lit("")
        mtg = F.col("o.id") if owner == "meeting_id" else F.lit("")
        return df.select(rec.alias("record_id"), mtg.alias("meeting_id"), F.posexplode(F.concat(*lists)).alias("pos", "x"))

    both = each("Paper", PAPER, (("mainFile", "vorlage"),), "record_id").unionByName(
        each("Meeting", MEETING, (("invitation", "einladung"), ("resultsProtocol", "ergebnisprotokoll"), ("verbatimProtocol", "wortprotokoll")), "meeting_id"))
    f = (both.filter(is_object(F.col("x.raw"))).select("record_id", "meeting_id", "pos", "x.role", F.from_json("x.raw", FILE).alias("f"))
         .filter("f.id is not null").withColumn("id", F.col("f.id")))
    first = first_per_key(f, ["record_id", "meeting_id", "id"], [F.col("pos")])
    shown = F.coalesce(F.nullif(blank("f.name"), F.lit("")), F.nullif(blank("f.fileName"), F.lit("")))
    return first.select("id", "record_id", "meeting_id", F.coalesce(shown, F.lit("Dokument")).alias("name"), blank("f.fileName").alias("file_name"),
                        blank("f.mimeType").alias("mime"), blank("f.date").alias("date"),
                        F.coalesce(F.nullif(blank("f.accessUrl"), F.lit("")), blank("f.downloadUrl")).alias("url"), blank("f.downloadUrl").alias("download_url"),
                        F.coalesce("role", file_role(F.coalesce(shown, F.lit("")))).alias("role"), blank("f.modified").alias("modified"),
                        truthy("f.deleted").alias("deleted"))


def _with_role(role):
    return lambda raw: F.struct(raw.alias("raw"), F.lit(role).cast("string").alias("role"))


def choose_body(bodies: DataFrame, cities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The one body of each city's system, and the cities without a single match.

    bodies: system, id, name, short_name, pos; cities: city, system, body_id, body_name. A wanted id
    matches by its end, else a wanted name by containment; with neither the first body counts.
    """
    wanted, by_id = norm("body_name"), blank("body_id") != ""
    names = F.concat_ws(" | ", norm("name"), norm("short_name"))
    match = (F.when(by_id, F.endswith("id", F.concat(F.lit("/"), F.col("body_id"))))
             .when(wanted != "", F.contains(names, wanted)).otherwise(F.lit(True)))
    hits = cities.join(bodies, "system").filter(match)
    w = Window.partitionBy("city")
    hits = (hits.withColumn("n_matches", F.count(F.lit(1)).over(w)).withColumn("_rn", F.row_number().over(w.orderBy("pos", "id")))
            .withColumn("_ambiguous", ~by_id & (wanted != "") & (F.col("n_matches") > 1)))
    chosen = hits.filter("_rn = 1 and not _ambiguous").select("city", F.col("id").alias("body"))
    counts = hits.select("city", "n_matches").distinct()
    rejects = (cities.join(chosen.select("city"), "city", "left_anti").join(counts, "city", "left")
               .select("city", F.coalesce("n_matches", F.lit(0)).alias("n_matches")))
    return chosen, rejects
