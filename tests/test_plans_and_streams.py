"""Incremental jobs over several batches against their batch forms; idempotence of loads."""

import json

import numpy as np
from helpers import CITY, dims
from pyspark.sql import functions as F

from townledger.operators import reports as R
from townledger.operators import tables as T
from townledger.plans import ingest as I
from townledger.streaming import deltas as D
from townledger.streaming import jobs as J


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def arriving(spark, tmp_path, df, parts):
    """The rows as a folder of several files, read one file per batch."""
    for i, cond in enumerate(parts):
        df.filter(cond).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_deltas_are_idempotent_and_compact(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(i, f"a{i}") for i in range(50)], "id int, v string")
    second = spark.createDataFrame([(i, f"b{i}") for i in range(40, 60)], "id int, v string")
    for number, batch in ((0, first), (1, second), (1, second)):
        D.write_delta(batch, path, number)
    expected = {i: f"a{i}" for i in range(40)} | {i: f"b{i}" for i in range(40, 60)}
    assert {r.id: r.v for r in J.current_rows(spark, path, ["id"]).collect()} == expected and D.deltas(spark, path).count() == 70
    D.compact(spark, path, ["id"], str(tmp_path / "c"))
    assert {r.id: r.v for r in J.current_rows(spark, str(tmp_path / "c"), ["id"]).collect()} == expected and D.deltas(spark, str(tmp_path / "c")).count() == 60
    assert D.deltas(spark, str(tmp_path / "none"), "id int").count() == 0


def test_stream_upsert_keeps_latest_of_overlapping_batches(spark, tmp_path):
    df = spark.createDataFrame([(k, n, f"{k}{n}") for k in "abc" for n in range(5)], "id string, n int, v string")
    s = arriving(spark, tmp_path, df, ["n = 4 and id = 'a'", "n <= 2", "n >= 2"])
    J.stream_upsert(s, str(tmp_path / "out"), ["id"], ["n"], str(tmp_path / "ck")).awaitTermination()
    assert rows(J.current_rows(spark, str(tmp_path / "out"), ["id"]), "id", "v") == [("a", "a4"), ("b", "b4"), ("c", "c4")]
    written = {r.batch: r.n for r in spark.read.parquet(str(tmp_path / "out")).groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert sum(written.values()) <= 1 + 3 + 3  # a batch writes the keys it touches


def test_stream_changes_equal_batch(spark, tmp_path):
    df = spark.createDataFrame([(k, i, h) for k in "pq" for i, h in enumerate("AABBAAAC")], "id string, seq int, content_hash string")
    s = arriving(spark, tmp_path, df, ["seq < 3", "seq >= 3 and seq < 6", "seq >= 5"])
    J.stream_changes(s, str(tmp_path / "h"), str(tmp_path / "ck")).awaitTermination()
    batch = T.changed_only(df, ["id"], "seq", F.floor(F.col("seq") / 2))
    assert rows(spark.read.parquet(str(tmp_path / "h")), "id", "seq") == rows(batch, "id", "seq")


def test_stream_closure_waits_for_the_marker(spark, tmp_path):
    data = [("s", "a", "r1", False), ("s", "b", "r1", False), ("s", "", "r1", True), ("s", "a", "r2", False)]
    schema = "source_id string, id string, run_id string, marker boolean"
    df = spark.createDataFrame(data, schema)

    def state():
        return rows(J.listed_state(spark.read.parquet(str(tmp_path / "e"))), "id", "listed")

    s = arriving(spark, tmp_path, df, ["run_id = 'r1'", "run_id = 'r2'"])
    J.stream_closure(s, str(tmp_path / "e"), str(tmp_path / "ck")).awaitTermination()
    assert state() == [("a", True), ("b", True)]
    s = arriving(spark, tmp_path, spark.createDataFrame([("s", "", "r2", True)], schema), ["true"])
    J.stream_closure(s, str(tmp_path / "e"), str(tmp_path / "ck")).awaitTermination()
    assert state() == [("a", True), ("b", False)]


def test_stream_demand_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(c, 1_700_000_000 + 97 * i + (3_000_000 if i > 40 else 0)) for c in "xy" for i in range(60)], "city string, s long")
    df = df.select("city", F.timestamp_seconds("s").alias("at"), "s")
    s = arriving(spark, tmp_path, df, ["city = 'x' AND s % 2 = 1", "city = 'y'", "city = 'x'"])
    J.stream_demand(s, str(tmp_path / "d"), str(tmp_path / "ck")).awaitTermination()
    assert rows(J.demand_state(spark, str(tmp_path / "d"))) == rows(R.demand(df))


def test_stream_annotate_replaces_earlier_places(spark, tmp_path):
    df = spark.createDataFrame([(CITY, "1", "Radweg in Niehl"), (CITY, "2", "Nichts"), (CITY, "1", "Radweg in Bickendorf")], "city string, id string, title string")
    s = arriving(spark, tmp_path, df, ["title like '%Niehl%' or id = '2'", "title like '%Bickendorf%'"])
    J.stream_annotate(s, dims(spark), str(tmp_path / "p"), str(tmp_path / "ck"), ("title", "betreff")).awaitTermination()
    assert rows(J.annotated(spark, str(tmp_path / "p")), "id", "type", "key") == [("1", "bezirk", "4"), ("1", "stadtteil", "403")]


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    from checks import all_queries  # noqa: F401  (registers the queries)
    from checks.base import QUERIES
    files = "/root/testdata/sf0.001"
    for name in ("benchmark", "region", "nation", "part", "documents"):
        spark.read.parquet(f"{files}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = rows(QUERIES["stream_annotate"](spark, str(tmp_path)))
    assert got and got == rows(QUERIES["stream_annotate"](spark, files))


def test_council_load_and_recompute(spark):
    paper = {"id": "p1", "type": "x/Paper", "name": "Radweg Feldgärtenstr.", "consultation": [{"id": "c1", "organization": ["o1"]}], "location": {"postalCode": "50823"}}
    org = {"id": "o1", "type": "x/Organization", "name": "Bezirksvertretung 4 (Ehrenfeld)"}
    objs = spark.createDataFrame([("s", CITY, "Paper", json.dumps(paper)), ("s", CITY, "Organization", json.dumps(org))], "source_id string, city string, type string, obj string")
    d = dims(spark)
    load = I.ingest_council(objs, d)
    assert rows(load["places"], "type", "key", "provenance") == [("bezirk", "4", "gremium"), ("bezirk", "5", "strasse"), ("plz", "50823", "oparl"), ("stadtteil", "501", "strasse")]
    rec = load["records"].select("city", "id", "title")
    none = rec.limit(0)
    entries = none.select("id", F.lit("").alias("short_text"), F.lit("").alias("category"), F.lit("").alias("step"))
    plans = none.select("id", F.lit("").alias("description"))
    table, diff, counters = I.recompute_places(rec, entries, plans, load["places"].filter("key <> '501'"), d)
    c = counters.first()
    assert (c.checked, c.updated, c.added, c.from_street) == (1, 1, 1, 1)
    again, diff2, counters2 = I.recompute_places(rec, entries, plans, table, d)
    assert diff2.count() == 0 and counters2.first().updated == 0 and rows(again) == rows(table)


def test_every_query_is_registered_with_sql():
    import __spark_entry__ as entry
    from checks.base import QUERIES, SQL
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) - set(SQL) == {"sentence_extracts", "understand_questions", "answer_questions"}


def test_spans_of_a_batch_are_worked_out_together(spark):
    """One call takes many spans and finds for each what the greedy rule finds from any last pick before it."""
    rng = np.random.default_rng(3)
    lists, spans = [], []
    for n in (1, 2, 3, 40, 300):
        for k in (0, 1, 700):
            for width in (500, 5_000, R.SPAN_S):
                lists.append(np.unique(k * R.SPAN_S + rng.integers(0, width, n)))
                spans.append(k)
    cases = R.span_cases(lists, np.array(spans), 600)
    for i, (seconds, k) in enumerate(zip(lists, spans)):
        mine = [{c: int(v[j]) for c, v in cases.items()} for j in np.flatnonzero(cases["row"] == i)]
        for last in (-10 ** 15, *(k * R.SPAN_S - d for d in (1, 250, 599, 600, 4_000))):
            picks, at = [], last
            for s in seconds.tolist():
                if s >= at + 600:
                    picks.append(s)
                    at = s
            held = [c for c in mine if c["lo"] <= last <= c["hi"]]
            assert len(held) == 1 and held[0]["n"] == len(picks)
            assert not picks or (held[0]["first_s"], held[0]["last_s"]) == (picks[0], picks[-1])


def test_stream_demand_calls_python_per_batch_not_per_span(spark, tmp_path):
    df = spark.range(400).select(F.col("id").cast("string").alias("city"), F.lit(None).cast("timestamp").alias("at"))
    df = df.unionByName(spark.range(400).select(F.col("id").cast("string").alias("city"), F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("at")))
    s = arriving(spark, tmp_path, df, ["city < '3'", "city >= '2'"])
    q = J.stream_demand(s, str(tmp_path / "d"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert "InPandasWithState" not in q._jsq.explainInternal(False)
    assert J.demand_state(spark, str(tmp_path / "d")).agg(F.sum("n")).first()[0] == 400
