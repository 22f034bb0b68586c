"""Reports on what was loaded and when: counts, load states, runs, demand and cities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import REPORT_ROLES, SOURCE_LABELS, STATE_LABELS, counter_label, lookup, rank_in, role_label, with_unit
from ..functions.text import blank
from ..session import cut_lineage, left_join
from .topk import top_per_group

FAILED = ("gesperrt", "nicht erreichbar")
PAUSE_BASE_S, PAUSE_MAX_S = 600, 21_600
DEMAND_GAP_S = 600
SPAN_S = 28 * 86_400  # at most this many distinct seconds meet in one task


def live(df: DataFrame) -> DataFrame:
    return df.filter(~F.coalesce("deleted", F.lit(False)))


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """Live rows per table."""
    parts = [live(df).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def document_sources(documents: DataFrame, records: DataFrame, meetings: DataFrame) -> DataFrame:
    """Live documents with the source of their record, else of their meeting."""
    r = records.select(F.col("id").alias("record_id"), F.col("source_id").alias("_rs"))
    m = meetings.select(F.col("id").alias("meeting_id"), F.col("source_id").alias("_ms"))
    source = F.coalesce(F.nullif("_rs", F.lit("")), F.nullif("_ms", F.lit("")))
    return left_join(left_join(live(documents), r, "record_id", "id"), m, "meeting_id", "id").withColumn("source_id", source).drop("_rs", "_ms")


COUNTERS = ("records", "meetings", "committees", "agenda_items", "consultations", "documents", "plans", "snapshots",
            "hints", "entries", "notices", "participations")


def counts_by_source(t: dict[str, DataFrame], docs: DataFrame | None = None) -> DataFrame:
    """Twelve counters per source. Every table is read once: of records and meetings narrow rows are kept, and rows that refer to them
    are counted together with them by id, so that no frequent or blank id is ever joined.

    Agenda items do not look at their meeting's flag, snapshots ignore deletion, hints have none. ``docs`` are the documents
    with their source, if they are there already.
    """
    gone = F.coalesce("deleted", F.lit(False)).alias("gone")
    rec = cut_lineage(t["records"].select("id", "source_id", "kind", gone))
    mtg = cut_lineage(t["meetings"].select("id", "source_id", gone))
    if docs is None:
        docs = document_sources(t["documents"], rec, mtg)

    def by_id(parents: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
        """One row per parent with the number of its children of each kind."""
        rows = parents.withColumn("child", F.lit(None).cast("string"))
        for name, ids in children.items():
            rows = rows.unionByName(ids.withColumn("child", F.lit(name)), allowMissingColumns=True)
        own = [F.max(c).alias(c) for c in parents.columns if c != "id"]
        found = rows.groupBy("id").agg(F.max(F.col("child").isNull()).alias("_known"), *own, *[F.count_if(F.col("child") == n).alias(n) for n in children])
        return found.filter("_known").drop("_known")

    def counted(df: DataFrame, **counters: Column) -> DataFrame:
        each = F.array(*[F.struct(F.lit(name).alias("counter"), n.cast("long").alias("n")) for name, n in counters.items()])
        return df.select("source_id", F.explode(each).alias("x")).select("source_id", "x.*")

    records = by_id(rec, {"consultations": live(t["consultations"]).select(F.col("record_id").alias("id")), "plans": t["plans"].select("id"),
                          "snapshots": t["snapshots"].select("id"), "entries": t["entries"].select("id")})
    meetings = by_id(mtg, {"agenda_items": live(t["agenda_items"]).select(F.col("meeting_id").alias("id"))})
    there = lambda n: F.when(~F.col("gone"), n).otherwise(0)
    of_kind = lambda k: F.when(F.col("kind") == k, there(F.col("entries"))).otherwise(0)
    rows = counted(records, records=there(F.lit(1)), consultations=F.col("consultations"), plans=there(F.col("plans")), snapshots=F.col("snapshots"),
                   entries=there(F.col("entries")), notices=of_kind("Bekanntmachung"), participations=of_kind("Beteiligungsangebot"))
    rows = rows.unionByName(counted(meetings, meetings=there(F.lit(1)), agenda_items=F.col("agenda_items")))
    for name, df in (("committees", live(t["committees"])), ("documents", docs), ("hints", t["hints"])):
        rows = rows.unionByName(df.select("source_id", F.lit(name).alias("counter"), F.lit(1).cast("long").alias("n")))
    return (rows.filter("source_id is not null AND n > 0").groupBy("source_id")
            .agg(*[F.coalesce(F.sum(F.when(F.col("counter") == c, F.col("n"))), F.lit(0)).alias(c) for c in COUNTERS]))


def documents_by_role(documents: DataFrame, records: DataFrame, meetings: DataFrame) -> DataFrame:
    """Documents per source and role with the role's place in the report."""
    return roles_of(document_sources(documents, records, meetings))


def roles_of(docs: DataFrame) -> DataFrame:
    role = F.coalesce(F.nullif("role", F.lit("")), F.lit("dokument"))
    return (docs.groupBy(F.coalesce("source_id", F.lit("")).alias("source_id"), role.alias("role"))
            .agg(F.count(F.lit(1)).alias("n")).withColumn("role_rank", rank_in("role", REPORT_ROLES))
            .withColumn("role_text", role_label("role")))


def roles_overall(by_role: DataFrame) -> DataFrame:
    return by_role.groupBy("role", "role_rank", "role_text").agg(F.sum("n").alias("n"))


def newest_documents(documents: DataFrame, records: DataFrame, meetings: DataFrame, limit: int = 25) -> DataFrame:
    """Newest document links per source; no task sorts a whole source."""
    return newest_of(document_sources(documents, records, meetings), limit)


def newest_of(docs: DataFrame, limit: int = 25) -> DataFrame:
    order = [F.col("date").desc(), F.col("name"), F.col("id"), F.col("record_id"), F.col("meeting_id")]
    return top_per_group(docs.filter("source_id is not null"), ["source_id"], order, limit, salt_by=["id"], rank="position")


def records_by_source(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Live records per source with their city."""
    n = live(records).groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return sources.select("id", "city").join(n, "id", "left").fillna(0, ["n"])


def load_state(sources: DataFrame, counts: DataFrame, now) -> DataFrame:
    """State of each source by the first rule that holds; a pause counts only while it lasts."""
    c = counts.select(F.col("source_id").alias("id"), (F.col("records") + F.col("meetings") + F.col("hints")).alias("_stock"))
    paused = F.col("pause_until").try_cast("timestamp") > F.lit(now).cast("timestamp")
    state = (F.when(F.coalesce("sample", F.lit(False)), "beispiel").when(F.coalesce(paused, F.lit(False)), "pause")
             .when(F.col("status") == "laeuft", "laeuft").when(F.col("status").isin(*FAILED, "fehler"), "fehler")
             .when(F.col("status") == "teilweise", "teilweise")
             .when((F.col("status") == "ok") & (F.coalesce("_stock", F.lit(0)) > 0), "aktuell").otherwise("nie"))
    return (sources.join(c, "id", "left").withColumn("state", state).withColumn("state_text", lookup("state", STATE_LABELS))
            .drop("_stock"))


def latest_runs(runs: DataFrame, n: int = 8, source: str | None = None) -> DataFrame:
    """Newest runs per source, newest first."""
    df = runs if source is None else runs.filter(F.col("source_id") == source)
    return top_per_group(df, ["source_id"], [F.col("id").desc()], n, salt_by=["id"], rank="position")


def run_log(runs: DataFrame) -> DataFrame:
    """Runs with duration and their counters labelled and sorted by falling count."""
    a, b = F.col("started").try_cast("timestamp"), F.col("ended").try_cast("timestamp")
    pairs = F.transform(F.map_entries(F.coalesce("counters", F.create_map().cast("map<string,bigint>"))),
                        lambda e: F.struct((-e["value"]).alias("neg"), counter_label(e["key"]).alias("text"),
                                           e["key"].alias("key"), e["value"].alias("n")))
    listed = F.transform(F.array_sort(pairs), lambda e: F.struct(e["key"].alias("key"), e["text"].alias("text"), e["n"].alias("n")))
    return (runs.withColumn("seconds", F.greatest(F.lit(0), F.unix_timestamp(b) - F.unix_timestamp(a)))
            .withColumn("state_text", lookup("status", STATE_LABELS, F.col("status"))).withColumn("counter_list", listed))


def consecutive_failures(runs: DataFrame) -> DataFrame:
    """Failed runs in a row at the end of each source's log: those after its newest run that did not fail."""
    failed = F.coalesce(F.col("status").isin(*FAILED), F.lit(False))
    good = runs.groupBy("source_id").agg(F.max(F.when(~failed, F.col("id"))).alias("_good"))
    return (runs.filter(failed).select("source_id", "id").join(good, "source_id", "right")
            .groupBy("source_id").agg(F.count_if(F.col("id").isNotNull() & (F.col("_good").isNull() | (F.col("id") > F.col("_good")))).cast("int").alias("failures")))


def cool_down(sources: DataFrame, failures: DataFrame) -> DataFrame:
    """Earliest next attempt: the pause doubles with every failure in a row, a longer server pause wins."""
    f = failures.select(F.col("source_id").alias("id"), "failures")
    n = F.greatest(F.coalesce("failures", F.lit(0)), F.lit(1))
    wait = F.least(F.lit(PAUSE_MAX_S), F.lit(PAUSE_BASE_S) * F.pow(F.lit(2), F.least(n, F.lit(20)) - 1)).cast("int")
    failed = F.col("status").isin(*FAILED) & (blank("last_try") != "")
    own = F.when(failed, F.col("last_try").try_cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), wait))
    pause = F.when(failed, F.col("pause_until").try_cast("timestamp"))
    return (sources.join(f, "id", "left").withColumn("wait_seconds", F.when(failed, wait))
            .withColumn("not_before", F.greatest(own, pause)).drop("failures"))


def next_due(sources: DataFrame, interval_s: int) -> DataFrame:
    """Next regular load: last attempt plus the interval, not before a pause ends."""
    last = F.col("last_try").try_cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(interval_s))
    return sources.withColumn("next_due", F.greatest(last, F.col("pause_until").try_cast("timestamp")))


# Steps of the way from the source to the search: kind of source, step, what is counted as (counter, one, many), rule of its state.
# Counters that start with "run:" are sums of the run log. Rules: "loaded" if anything is there, "list" for lists that may be
# unfinished, "queue" for open detail pages, "sample", or the name of a counter that must not be zero.
PATH_STEPS = (
    ("oparl", "Abruf", (), "loaded"),
    ("oparl", "Listen", (("committees", "Gremium", "Gremien"), ("records", "Vorlage", "Vorlagen"), ("meetings", "Sitzung", "Sitzungen")), "list"),
    ("oparl", "Objekte", (("agenda_items", "Tagesordnungspunkt", "Tagesordnungspunkte"), ("consultations", "Beratung", "Beratungen")), "loaded"),
    ("bauleitplanung", "Abruf", (), "loaded"),
    ("bauleitplanung", "Verfahrensliste", (("records", "Verfahren", "Verfahren"),), "list"),
    ("bauleitplanung", "Detailseiten", (("n_open", "Seite offen", "Seiten offen"),), "queue"),
    ("feed", "Abruf", (), "loaded"),
    ("feed", "Hinweise", (("hints", "Hinweis", "Hinweise"),), "hints"),
    ("bekanntmachungen", "Abruf", (), "loaded"),
    ("bekanntmachungen", "Listen", (("notices", "Bekanntmachung", "Bekanntmachungen"),), "list"),
    ("bekanntmachungen", "Verweise", (("documents", "Original", "Originale"),), "documents"),
    ("opendata", "Abruf", (), "loaded"),
    ("opendata", "Datensätze", (("run:opendata:datensaetze", "Datensatz", "Datensätze"), ("run:opendata:uebersprungen_lizenz", "nicht offener", "nicht offene")), "list"),
    ("opendata", "Lizenzen", (), "loaded"),
    ("opendata", "Zeilen", (("run:opendata:neu", "neue Zeile", "neue Zeilen"), ("run:opendata:aktualisiert", "geänderte Zeile", "geänderte Zeilen")), "run:opendata:neu"),
    ("beteiligung", "Abruf", (), "loaded"),
    ("beteiligung", "Projekte", (("participations", "Projekt", "Projekte"), ("documents", "Verweis", "Verweise")), "participations"),
    ("beteiligung", "Beiträge", (), "loaded"),
    ("other", "Abruf", (), "sample"),
    ("other", "Beispieldaten", (("records", "Vorgang", "Vorgänge"),), "sample"),
)
PATH_END = (
    ("Dokumente", (("documents", "Verweis", "Verweise"),), "documents"),
    ("Suche", (("records", "Vorgang", "Vorgänge"), ("plans", "Planverfahren", "Planverfahren")), "records"),
)
FEED_TYPES = ("ris-rss", "presse-rss")


def load_path(sources: DataFrame, counts: DataFrame, open_lists: DataFrame, queue: DataFrame, run_counters: DataFrame) -> DataFrame:
    """The way of the data from the source to the search, as an ordered list of steps with counts.

    ``open_lists``: source_id (with a pending next page); ``queue``: source_id, n_open;
    ``run_counters``: source_id, counters (sums of the run log, for open data).
    """
    df = (sources.join(counts.withColumnRenamed("source_id", "id"), "id", "left").fillna({c: 0 for c in COUNTERS})
          .join(open_lists.select(F.col("source_id").alias("id")).distinct().withColumn("_open", F.lit(True)), "id", "left")
          .join(queue.select(F.col("source_id").alias("id"), "n_open"), "id", "left").fillna(0, ["n_open"])
          .join(run_counters.select(F.col("source_id").alias("id"), F.col("counters").alias("_rc")), "id", "left"))

    def number(counter: str) -> Column:
        return F.coalesce(F.try_element_at("_rc", F.lit(counter[4:])), F.lit(0)) if counter.startswith("run:") else F.col(counter)

    loaded = F.when(F.greatest(*[F.col(c) for c in ("records", "meetings", "documents", "hints")]) > 0, "ok").otherwise("wartet")
    named = {"loaded": loaded, "list": F.when(F.col("_open"), "offen").otherwise(loaded), "queue": F.when(F.col("n_open") > 0, "offen").otherwise(loaded),
             "sample": F.lit("beispiel")}

    def step(name: str, counted, rule: str) -> Column:
        value = F.concat_ws(" · ", *[with_unit(number(c), one, many) for c, one, many in counted])
        state = named[rule] if rule in named else F.when(number(rule) > 0, "ok").otherwise("leer")
        return F.struct(F.lit(name).alias("step"), value.alias("value"), state.alias("state"))

    end = [step(*row) for row in PATH_END]
    kinds = list(dict.fromkeys(k for k, *_ in PATH_STEPS))
    paths = {k: F.array(*[step(*row) for kind, *row in PATH_STEPS if kind == k], *end) for k in kinds}
    kind = F.when(F.col("type").isin(*FEED_TYPES), "feed").otherwise(F.col("type"))
    choice = paths.pop("other")
    for k, path in paths.items():
        choice = F.when(kind == k, path).otherwise(choice)
    return df.select("id", choice.alias("path"))


def run_counter_sums(runs: DataFrame) -> DataFrame:
    """Sums of all run counters per source as a map; the set of counter names is fixed and small."""
    each = runs.select("source_id", F.explode("counters").alias("k", "v")).groupBy("source_id", "k").agg(F.sum("v").alias("v"))
    return each.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("counters"))


def configured_and_stored(configured: DataFrame, stored: DataFrame) -> DataFrame:
    """Configured sources in their order, with or without a row, then stored-only ones (samples last).

    configured: id, city, key, name, type, pos; stored: the sources table.
    """
    c = configured.select("id", F.col("city").alias("c_city"), F.col("name").alias("c_name"), F.col("type").alias("c_type"), "pos")
    s = stored.select("id", "city", "name", "type", "sample", "status", "last_success", "last_try", "error", "pause_until")
    df = c.join(s, "id", "full_outer")
    return df.select("id", F.coalesce("c_city", "city").alias("city"),
                     F.coalesce(F.nullif("name", F.lit("")), "c_name", "id").alias("name"), F.coalesce("c_type", "type").alias("type"),
                     F.coalesce("sample", F.lit(False)).alias("sample"), F.coalesce("status", F.lit("nie")).alias("status"),
                     *[blank(x).alias(x) for x in ("last_success", "last_try", "error", "pause_until")],
                     F.col("pos").isNotNull().alias("configured"), F.coalesce("pos", F.lit(1_000_000)).alias("pos"))


def load_report(t: dict[str, DataFrame], configured: DataFrame, now, interval_s: int = 21_600, active: bool = True, n_runs: int = 8) -> DataFrame:
    """One row per source of the configured cities: state, counters, roles, cursors, path, runs, documents."""
    docs = cut_lineage(document_sources(t["documents"], t["records"], t["meetings"]))
    counts = cut_lineage(counts_by_source(t, docs))
    base = configured_and_stored(configured, t["sources"])
    state = next_due(load_state(base, counts, now), interval_s)
    roles = (roles_of(docs).groupBy(F.col("source_id").alias("id"))
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("role_rank", (-F.col("n")).alias("neg"), "role", "n"))),
                              lambda r: F.struct(r["role"].alias("role"), r["n"].alias("n"))).alias("documents_by_role")))
    runs = (run_log(latest_runs(t["runs"], n_runs)).groupBy(F.col("source_id").alias("id"))
            .agg(F.array_sort(F.collect_list(F.struct("position", F.col("id").alias("run_id"), "started", "ended", "status", "seconds", "requests",
                                                      "counter_list", F.col("error")))).alias("runs")))
    newest = (newest_of(docs).groupBy(F.col("source_id").alias("id"))
            .agg(F.array_sort(F.collect_list(F.struct("position", F.coalesce(F.nullif("name", F.lit("")), F.lit("Dokument")).alias("name"),
                                                      "role", "date", "url"))).alias("newest_documents")))
    cursors = (t["cursors"].groupBy(F.col("source_id").alias("id"))
               .agg(F.array_sort(F.collect_list(F.struct("entity", "modified_since", "updated", (blank("next_url") != "").alias("open"),
                                                         "series_start"))).alias("cursors")))
    queue = t["detail_queue"].groupBy("source_id").agg(F.count(F.lit(1)).alias("n_open"))
    path = load_path(base, counts, t["cursors"].filter(blank("next_url") != ""), queue, run_counter_sums(t["runs"]))
    df = state.join(counts.withColumnRenamed("source_id", "id"), "id", "left").fillna({c: 0 for c in COUNTERS})
    for part in (roles, runs, newest, cursors, path, queue.withColumnRenamed("source_id", "id")):
        df = df.join(part, "id", "left")
    for c in ("documents_by_role", "runs", "newest_documents", "cursors"):  # a source without any has an empty list
        df = df.withColumn(c, F.coalesce(c, F.array().cast(df.schema[c].dataType)))
    due = F.when(F.lit(active) & ~F.col("sample"), F.col("next_due"))
    return (df.fillna(0, ["n_open"]).withColumn("next_due", due)
            .withColumn("type_text", lookup("type", SOURCE_LABELS, F.col("type"))))


def report_totals(report: DataFrame) -> DataFrame:
    """Totals per city over the sources of the report, and hints that follow from them by rule."""
    agg = report.groupBy("city").agg(
        *[F.sum(c).alias(c) for c in ("records", "documents", "meetings", "committees", "agenda_items", "consultations")],
        F.count(F.lit(1)).alias("sources"), F.count_if(~F.col("sample")).alias("live_sources"),
        F.count_if((F.col("records") > 0) | (F.col("documents") > 0)).alias("stocked_sources"),
        F.min(F.col("state") == "beispiel").alias("_samples_only"), F.max(F.col("state") == "pause").alias("_paused"),
        F.max(F.size("runs") > 0).alias("_any_run"))
    hints = F.array_compact(F.array(
        F.when(F.col("_samples_only"), "Bisher gibt es nur Beispiele."),
        F.when(~F.col("_any_run"), "Bisher ist nichts geladen worden."),
        F.when(F.col("_paused"), "Eine Quelle oder mehrere pausieren."),
        F.lit("Gezeigt wird, was geladen ist; Dokumente sind Verweise.")))
    return agg.withColumn("hints", hints).drop("_samples_only", "_paused", "_any_run")


# --- demand ------------------------------------------------------------------

def _chains(seconds: np.ndarray, first: np.ndarray, gap: int, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of greedy picks and the place of the last one, for each place of a first pick; a chain ends before ``stop``."""
    at, count, live = first.copy(), np.ones(len(first), dtype=np.int64), np.arange(len(first))
    while len(live):
        idx = np.searchsorted(seconds, seconds[at[live]] + gap, side="left")
        go = idx < stop[live]
        live = live[go]
        at[live] = idx[go]
        count[live] += 1
    return count, at


def demand(requests: DataFrame, gap_s: int = DEMAND_GAP_S) -> DataFrame:
    """First, last and number of noted requests per city; a repeat within the gap of the last NOTED one is ignored.

    Requests: city, at (timestamp). Repeats within a second are merged before the shuffle. The greedy
    rule is sequential, so each (city, span of days) works out its result for every range of last picks
    before it that makes a difference: a request in the first ``gap_s`` seconds may or may not be the
    first pick. A walk over the spans then strings them together. No task sees more than the seconds
    of one span, or a city's few cases per span.
    """
    s = F.unix_timestamp("at")
    spans = requests.select("city", F.floor(s / SPAN_S).cast("long").alias("span"), s.alias("s")).groupBy("city", "span").agg(F.collect_set("s").alias("seconds"))
    return walk_spans(cases_of_spans(spans, gap_s))


SPAN_CASES = "span long, lo long, hi long, n long, first_s long, last_s long"
ENDLESS = np.iinfo(np.int64).max


def span_cases(seconds: list[np.ndarray], span: np.ndarray, gap_s: int = DEMAND_GAP_S) -> dict[str, np.ndarray]:
    """What spans of sorted seconds note, for every range (lo to hi) of the last pick before each that makes a difference; ``row`` is the place of the span."""
    size = np.array([len(x) for x in seconds], np.int64)
    stop = np.cumsum(size)
    begin, row = stop - size, np.repeat(np.arange(len(size)), size)
    s = np.concatenate(seconds).astype(np.int64)
    # spans one after another on one axis, too far apart for a chain to go on in the next one
    base = np.arange(len(size)) * (SPAN_S + 2 * gap_s)
    axis = s - (span * SPAN_S - base)[row]
    n = np.minimum(np.searchsorted(axis, base + gap_s) - begin + 1, size)
    row = np.repeat(np.arange(len(size)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    first = begin[row] + place
    count, last = _chains(axis, first, gap_s, stop[row])
    whole = np.flatnonzero(n == size)  # the last pick may lie too close before all of them
    none = np.full(len(whole), -1)
    rows = {"row": (row, whole), "lo": (np.where(place == 0, -ENDLESS, s[first - 1] - gap_s + 1), s[stop[whole] - 1] - gap_s + 1),
            "hi": (s[first] - gap_s, np.full(len(whole), ENDLESS)), "n": (count, none + 1), "first_s": (s[first], none), "last_s": (s[last], none)}
    return {c: np.concatenate(v) for c, v in rows.items()}


def cases_of_spans(spans: DataFrame, gap_s: int = DEMAND_GAP_S) -> DataFrame:
    """Cases of all spans; rows are city, span, seconds (in any order)."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                cases = span_cases([np.sort(x) for x in pdf["seconds"]], pdf["span"].to_numpy(np.int64), gap_s)
                row = cases.pop("row")
                yield pd.DataFrame({"city": pdf["city"].to_numpy()[row], "span": pdf["span"].to_numpy()[row], **cases})

    return spans.filter("size(seconds) > 0").select("city", "span", "seconds").mapInPandas(run, f"city string, {SPAN_CASES}")


def walk_spans(cases: DataFrame) -> DataFrame:
    """Demand per city from the cases of its spans: of each span, in order, the one that holds for the last pick before it."""
    case = F.struct("span", "lo", "hi", "n", "first_s", "last_s")
    zero = F.struct(F.lit(-1).cast("long").alias("done"), F.lit(-ENDLESS).cast("long").alias("last"), F.lit(None).cast("long").alias("first"), F.lit(0).cast("long").alias("n"))

    def step(acc, c):
        holds = (c["span"] != acc["done"]) & (c["lo"] <= acc["last"]) & (acc["last"] <= c["hi"])
        picked = F.struct(c["span"].alias("done"), F.when(c["n"] > 0, c["last_s"]).otherwise(acc["last"]).alias("last"),
                          F.coalesce(acc["first"], F.when(c["n"] > 0, c["first_s"])).alias("first"), (acc["n"] + c["n"]).alias("n"))
        return F.when(holds, picked).otherwise(acc)

    out = (cases.groupBy("city").agg(F.aggregate(F.array_sort(F.collect_list(case)), zero, step).alias("r"))
           .select("city", F.col("r.first").alias("first_s"), F.col("r.last").alias("last_s"), "r.n"))
    return out.select("city", F.timestamp_seconds("first_s").alias("first_at"), F.timestamp_seconds("last_s").alias("last_at"), "n")


def active_cities(demands: DataFrame, cities: DataFrame, now, days: int, maximum: int) -> DataFrame:
    """On-demand cities whose demand still holds, most recent first, at most ``maximum``."""
    on_demand = cities.filter("on_demand").select("city")
    since = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    valid = demands.join(on_demand, "city", "left_semi").filter(F.col("last_at") >= since)
    w = Window.orderBy(F.col("last_at").desc(), F.col("city").desc())
    return (valid.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= maximum)
            .withColumn("valid_until", F.col("last_at") + F.make_dt_interval(F.lit(days))))


def city_overview(dims, sources: DataFrame, records: DataFrame, demands: DataFrame, now, default: str, on_demand_enabled: bool = True,
                  sync_active: bool = True, days: int = 14, maximum: int = 3) -> DataFrame:
    """All cities: default first, then permanent before on-demand, then by name; stock, hierarchy, state, examples."""
    stock = records_by_source(records, sources).groupBy("city").agg(F.sum("n").alias("stock"))
    ok = sources.groupBy("city").agg(F.max(blank("last_success") != "").alias("any_success"), F.count(F.lit(1)).alias("n_sources"))

    def count(df, name):
        return df.groupBy("city").agg(F.count(F.lit(1)).alias(name))

    names = dims.quarters.groupBy("city").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("nr").cast("int"), "name"))), lambda s: s["name"]).alias("q_names"))
    d_names = dims.districts.groupBy("city").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("nr").cast("int"), "name"))), lambda s: s["name"]).alias("d_names"))
    mapped = dims.postcode_quarters.groupBy("city").agg(F.min("plz").alias("plz_mapped"))
    any_plz = dims.postcodes.groupBy("city").agg(F.min("plz").alias("plz_any"))
    act = active_cities(demands, dims.cities, now, days, maximum).select("city", "valid_until").withColumn("_active", F.lit(True))
    df = dims.cities.select("city", "name", "on_demand")
    for part in (stock, ok, count(dims.districts, "n_districts"), count(dims.quarters, "n_quarters"), count(dims.postcodes, "n_postcodes"),
                 names, d_names, mapped, any_plz, act, demands.select("city", F.col("last_at").alias("asked_at"))):
        df = df.join(part, "city", "left")
    df = df.fillna(0, ["stock", "n_sources", "n_districts", "n_quarters", "n_postcodes"])
    enabled, sync = F.lit(on_demand_enabled), F.lit(sync_active)
    active = F.coalesce("_active", F.lit(False)) & enabled
    state = (F.when(~sync, "aus").when(~F.col("on_demand"), "aktiv").when(~enabled, "aus")
             .when(active, F.when(F.coalesce("any_success", F.lit(False)), "aktiv").otherwise("laedt")).otherwise("ruht"))
    level = F.when(F.col("n_quarters") > 0, "voll").when(F.col("n_districts") > 0, "bezirke").otherwise("keine")
    places = F.coalesce("q_names", "d_names", F.array("name"))
    first, second = F.element_at(places, 1), F.element_at(places, F.floor(F.size(places) / 2).cast("int") + 1)
    first = F.when(F.startswith(first, F.col("name")), first).otherwise(F.concat_ws(" ", "name", first))
    second = F.when(F.size(places) > 1, second).otherwise(F.element_at(places, 1))
    examples = F.array(F.concat(F.lit("Welche Bauvorhaben sind in "), first, F.lit(" geplant?")),
                       F.concat(F.lit("Was gibt es zu Verkehr in "), second, F.lit("?")),
                       F.concat(F.lit("Welche Vorlagen betreffen Wohnungsbau in "), F.col("name"), F.lit("?")))
    w = Window.orderBy((F.col("city") != default), "on_demand", "name", "city")
    return df.select(F.row_number().over(w).alias("position"), "city", "name", (F.col("city") == default).alias("is_default"), "on_demand",
                     state.alias("state"), "stock", "n_sources", level.alias("level"), "n_districts", "n_quarters", "n_postcodes",
                     examples.alias("examples"), F.coalesce("plz_mapped", "plz_any", F.lit("")).alias("example_postcode"), "asked_at", "valid_until")


def ingest_counters(batch: DataFrame) -> DataFrame:
    """Counters of a load: new, updated, without date, without place; batch has is_new, date, n_places."""
    return batch.agg(F.count_if("is_new").alias("new"), F.count_if(~F.col("is_new")).alias("updated"),
                     F.count_if(blank("date") == "").alias("without_date"), F.count_if(F.coalesce("n_places", F.lit(0)) == 0).alias("without_place"))
