"""Loads from landed answers to table rows: parse, annotate, split into tables, count.

Every load returns a dict of frames to merge; what was rejected comes along as frames of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import local_day, moment
from ..functions.text import blank, norm
from ..operators import places as P
from ..operators import tables as T
from ..operators.dims import CityDims
from ..sources import council as C
from ..sources import feeds, notices, opendata, planning

PLAN_KIND = "Bauleitplanung / Beteiligungsverfahren"
SNAPSHOT_FIELDS = ("title", "phase", "begin", "end", "description", "organisation", "permission")


def _with_city(df: DataFrame, sources: DataFrame) -> DataFrame:
    return df.drop("city").join(sources.select(F.col("id").alias("source_id"), "city"), "source_id")


def ingest_council(objects: DataFrame, dims: CityDims, committees: DataFrame | None = None) -> dict[str, DataFrame]:
    """Committees, papers and meetings of landed objects (source_id, city, type, obj).

    Papers use the names of stored and newly delivered committees for their places. Deleted objects
    come out as id lists for the delete path.
    """
    org, papers, cons = C.organizations(objects), C.papers(objects), C.consultations(objects)
    names = org.select(F.col("id").alias("committee_id"), "name")
    if committees is not None:
        old = committees.select(F.col("id").alias("committee_id"), "name")
        names = names.unionByName(old.join(names.select("committee_id"), "committee_id", "left_anti"))
    named = (cons.select(F.col("record_id").alias("id"), F.explode("committee_ids").alias("committee_id")).join(names, "committee_id")
             .join(papers.select("id", "city"), "id").select("city", "id", "name").distinct())
    texts = P.council_texts(papers, named)
    places = P.match_places(texts, dims).unionByName(P.structured_places(C.paper_locations(objects), dims)).distinct()
    return {"committees": org, "records": papers, "consultations": cons.drop("pos"), "meetings": C.meetings(objects), "agenda_items": C.agenda_items(objects),
            "documents": C.file_refs(objects), "relations": C.paper_relations(objects), "places": places.drop("city"),
            "deleted_committees": C.deleted_ids(objects, "Organization"), "deleted_meetings": C.deleted_ids(objects, "Meeting"), "deleted_records": C.deleted_ids(objects, "Paper")}


def council_counters(objects: DataFrame) -> DataFrame:
    """Stored and deleted objects per kind of a load."""
    gone = C.truthy(F.get_json_object("obj", "$.deleted"))
    has_id = blank(F.get_json_object("obj", "$.id")) != ""
    return (objects.filter(has_id).groupBy("source_id", "type").agg(F.count_if(~gone).alias("saved"), F.count_if(gone).alias("deleted")))


def merge_council(stored: dict[str, DataFrame], load: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Stored tables after a council load: upserts, child replacement, then deletions with their cascade."""
    out = dict(stored)
    for name in ("committees", "records", "meetings"):
        out[name] = T.upsert(stored[name], load[name].select(*[c for c in load[name].columns if c in stored[name].columns]), ["id"])
    records, meetings = load["records"].select(F.col("id").alias("record_id")), load["meetings"].select(F.col("id").alias("meeting_id"))

    def children(name, parent, touched):
        return T.replace_children(stored[name], load[name].select(*stored[name].columns), parent, touched)

    out["consultations"] = children("consultations", "record_id", records)
    out["agenda_items"] = children("agenda_items", "meeting_id", meetings)
    out["relations"] = children("relations", "from_id", records.withColumnRenamed("record_id", "from_id"))
    out["places"] = children("places", "id", records.withColumnRenamed("record_id", "id"))
    both = records.select("record_id", F.lit("").alias("meeting_id")).unionByName(meetings.select(F.lit("").alias("record_id"), "meeting_id"))
    out["documents"] = (stored["documents"].join(both.distinct(), ["record_id", "meeting_id"], "left_anti").select(*stored["documents"].columns)
                        .unionByName(load["documents"].select(*stored["documents"].columns)))
    for kind, ids in (("committee", "deleted_committees"), ("meeting", "deleted_meetings"), ("record", "deleted_records")):
        out = T.soft_delete(out, kind, load[ids])
    return out


def ingest_plans(pages: DataFrame, details: DataFrame, dims: CityDims, sources: DataFrame, organisation: str, template: str, run_id: str, observed: str) -> dict[str, DataFrame]:
    """Procedures, snapshots, places and the queue of detail pages from list pages; documents from stored details."""
    rows, rejects = planning.planning_procedures(pages, organisation, template)
    rows = _with_city(rows, sources)
    texts = P.plan_texts(rows)
    records = rows.select("id", "source_id", F.lit("").alias("reference"), "title", F.lit(PLAN_KIND).alias("kind"), local_day(moment("begin")).alias("date"), F.lit("").alias("modified"),
                          F.col("id").alias("web"), norm(F.concat_ws(" ", "title", F.lit("Bauleitplanung"), "phase", "description")).alias("search_text"), F.lit(False).alias("deleted"))
    plans = rows.select("id", "source_id", "phase", "begin", "end", "description", "organisation", "permission", F.lit(observed).alias("seen"), F.lit(run_id).alias("run_id"),
                        F.lit(True).alias("listed"), F.lit("offen").alias("detail_status"))
    snaps = T.content_hash(rows.select("id", *SNAPSHOT_FIELDS), SNAPSHOT_FIELDS)
    snaps = snaps.select("id", F.lit(observed).alias("observed"), "content_hash", F.struct(*SNAPSHOT_FIELDS).alias("content"))
    docs, status = planning.page_document_links(details)
    return {"records": records, "plans": plans, "snapshots": snaps, "places": P.match_places(texts, dims).drop("city"),
            "queue": rows.select("source_id", F.col("id").alias("record_id"), F.col("id").alias("url")), "documents": docs, "details": status, "rejects": rejects}


def _entries_load(entries: DataFrame, dims: CityDims, sources: DataFrame, seen: str, place_columns, doc_name, role: str | None, existing: DataFrame | None) -> dict[str, DataFrame]:
    """Common part of list sources: tables, places, documents and counters."""
    entries = _with_city(entries, sources)
    records, rows = notices.split_entries(entries, seen)
    places = P.match_places(P.entry_texts(entries, *place_columns), dims).drop("city")
    docs = notices.document_refs(entries, doc_name, role) if role else None
    n_places = places.groupBy("id").agg(F.count(F.lit(1)).alias("n_places"))
    known = T.classify_batch(existing, records, ["id"]) if existing is not None else records.withColumn("is_new", F.lit(True))
    from ..operators.reports import ingest_counters
    return {"records": records, "entries": rows, "places": places, **({"documents": docs} if docs is not None else {}),
            "counters": ingest_counters(known.join(n_places, "id", "left"))}


def ingest_notices(pages: DataFrame, dims: CityDims, sources: DataFrame, seen: str, existing: DataFrame | None = None) -> dict[str, DataFrame]:
    """Official notices of all stored list pages (source_id, page_id, url, html); an empty page adds nothing."""
    entries = notices.notice_entries(pages)
    one = T.dedupe_entries(entries)
    one = T.last_of_batch(one, ["id"], ["page_id", "pos"])
    title = F.when(F.col("title") != "", F.concat(F.lit("Bekanntmachung: "), F.col("title"))).otherwise("Bekanntmachung")
    return _entries_load(one, dims, sources, seen, ("title", "category"), title, "bekanntmachung", existing)


def ingest_participation(pages: DataFrame, dims: CityDims, sources: DataFrame, seen: str, existing: DataFrame | None = None) -> dict[str, DataFrame]:
    """Participation projects; pages without any card are failed batches and given back as such."""
    entries, rejected = notices.participation_entries(pages)
    failed = pages.join(rejected.filter("accepted > 0").select("page_id"), "page_id", "left_anti").select("source_id", "page_id", "url")
    one = T.last_of_batch(entries, ["id"], ["page_id", "pos"])
    return {**_entries_load(one, dims, sources, seen, ("title", "short_text"), None, None, existing), "rejected": rejected, "failed": failed}


def ingest_open_data(catalogue: DataFrame, answers: DataFrame, wanted: DataFrame, dims: CityDims, sources: DataFrame, today: str, seen: str, existing: DataFrame | None = None) -> dict[str, DataFrame]:
    """Rows of wanted, openly licensed, tabular datasets; what is skipped is counted by reason."""
    ds = opendata.datasets(catalogue)
    chosen, looked = opendata.select_datasets(ds, wanted)
    mine = ds.join(chosen.select("source_id", "dataset_id"), ["source_id", "dataset_id"], "left_semi")
    licensed = opendata.classify_licence(mine)
    tables = opendata.tabular_distributions(licensed)
    tabular = tables.select("dataset_id").distinct().withColumn("_table", F.lit(True))
    verdict = licensed.join(tabular, "dataset_id", "left").select(
        "source_id", "dataset_id", "title", "modified", "licence_text",
        F.when(F.col("licence_kind").isNull(), "licence").when(F.col("_table").isNull(), "no table").otherwise("taken").alias("verdict"))
    taken = verdict.filter("verdict = 'taken'")
    meta = taken.join(opendata.original_urls(tables), "dataset_id", "left").select("source_id", "dataset_id", "title", "modified", "licence_text", "original_url")
    read = answers.join(tables.select("dataset_id", "index"), ["dataset_id", "index"], "left_semi")
    shapes = opendata.row_shapes(read)
    rows = opendata.open_data_rows(read, shapes)
    entries = opendata.dataset_rows_to_entries(rows, meta.drop("source_id"), today, names=opendata.row_names(shapes)).join(meta.select("dataset_id", "source_id"), "dataset_id")
    one = T.last_of_batch(entries, ["id"], ["dataset_id", "title", "status_text"])
    name = F.concat(F.lit("Originaldatei: "), F.col("category"))
    load = _entries_load(one, dims, sources, seen, ("title", "short_text", "hidden_text"), name, "datensatz", existing)
    return {**load, "looked_up": looked, "verdicts": verdict.groupBy("source_id", "verdict").agg(F.count(F.lit(1)).alias("n"))}


def ingest_feeds(pages: DataFrame, loaded: str) -> dict[str, DataFrame]:
    """Session and press hints; they go to the hint table only."""
    rows, rejected, failed = feeds.hints(pages, loaded)
    return {"hints": T.last_of_batch(rows, ["source_id", "id"], ["date", "web"]), "rejected": rejected, "failed": failed}


def ingest_samples(objects: DataFrame, dims: CityDims, stored: DataFrame | dict[str, DataFrame], sources: DataFrame) -> dict[str, DataFrame]:
    """Recorded answers as sample data: objects that exist from a real source are skipped, with all that hangs on them.

    ``stored``: id and source_id of the stored records, or of records, meetings and committees by name.
    """
    stored = stored if isinstance(stored, dict) else {"records": stored}
    load = ingest_council(objects, dims)
    allowed = {n: T.real_over_sample(stored[n], load[n], sources).select("id") if n in stored else load[n].select("id") for n in ("records", "meetings", "committees")}

    def only(df: DataFrame, owner: str, column: str) -> DataFrame:
        return df.join(allowed[owner].withColumnRenamed("id", column), column, "left_semi").select(*df.columns)

    owners = {"records": ("records", "id"), "consultations": ("records", "record_id"), "relations": ("records", "from_id"), "places": ("records", "id"),
              "meetings": ("meetings", "id"), "agenda_items": ("meetings", "meeting_id"), "committees": ("committees", "id")}
    out = {n: only(df, *owners[n]) if n in owners else df for n, df in load.items()}
    docs = load["documents"]
    out["documents"] = only(docs.filter("record_id <> ''"), "records", "record_id").unionByName(only(docs.filter("record_id = ''"), "meetings", "meeting_id"))
    for kind, name in (("records", "deleted_records"), ("meetings", "deleted_meetings"), ("committees", "deleted_committees")):
        if kind in stored:  # a sample deletes nothing that a real source has delivered
            real = stored[kind].join(sources.filter(~F.coalesce("sample", F.lit(False))).select(F.col("id").alias("source_id")), "source_id", "left_semi").select("id")
            out[name] = load[name].join(real, "id", "left_anti")
    return out


REPLACEABLE = ("betreff", "beschreibung", "strasse")


def recompute_places(records: DataFrame, entries: DataFrame, plans: DataFrame, places: DataFrame, dims: CityDims) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Places anew from the stored texts: the new table, the differences, and the counters.

    ``records`` are live records with city. Running it again on its own result finds no difference.
    """
    r = (records.select("city", "id", "title")
         .join(entries.select("id", "short_text", "category", "step"), "id", "left").join(plans.select("id", "description"), "id", "left"))
    texts = P.texts_of(r, ("title", "betreff"), ("short_text", "betreff"), ("category", "betreff"), ("step", "betreff"), ("description", "beschreibung"))
    new = P.match_places(texts, dims).drop("city").select("id", "type", "key", "provenance")
    ids = records.select("id")
    old = places.filter(F.col("provenance").isin(*REPLACEABLE)).join(ids, "id", "left_semi").select("id", "type", "key", "provenance")
    diff = T.place_diff(old, new)
    touched = diff.select("id").distinct()
    counters = (diff.agg(F.count_distinct("id").alias("updated"), F.count_if(F.col("change") == "added").alias("added"),
                         F.count_if((F.col("change") == "added") & (F.col("provenance") == "strasse")).alias("from_street"))
                .withColumn("checked", records.agg(F.count(F.lit(1)).alias("n")).scalar()))
    table = T.replace_places(places.select("id", "type", "key", "provenance"), new.join(touched, "id", "left_semi"), touched, REPLACEABLE)
    return table, diff, counters
