"""The provided tables seen as municipal tables, in Spark and in SQL.

Districts are regions, quarters nations, postcodes part sizes; names and theme terms are words of
the benchmark texts; records are the documents, requests follow from the benchmark items, meetings
and agenda items from line items, committees from suppliers.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from townledger.functions.text import norm, tokens
from townledger.operators import places as P
from townledger.operators.dims import CityDims

from .base import cte, s_norm, s_tokens

CITY = "stadt"
TODAY = "2026-10-12"
NONE = "array<string>"

# --- dimensions -----------------------------------------------------------------

cte("bench_words", f"SELECT w, count(*) AS c FROM (SELECT unnest({s_tokens(s_norm('text'))}) AS w FROM benchmark) GROUP BY w")
cte("long_words", "SELECT w, row_number() OVER (ORDER BY c DESC, w) - 1 AS rk FROM bench_words WHERE length(w) >= 5", "bench_words")
cte("short_words", "SELECT w, row_number() OVER (ORDER BY c DESC, w) - 1 AS rk FROM bench_words WHERE length(w) BETWEEN 3 AND 4", "bench_words")
cte("bigrams", f"SELECT item_id, x[2] || ' ' || x[3] AS b FROM (SELECT item_id, {s_tokens(s_norm('text'))} AS x FROM benchmark) WHERE item_id < 25 AND len(x) >= 3")
cte("districts", "SELECT CAST(r_regionkey AS VARCHAR) AS nr, w AS name FROM region JOIN short_words ON rk = r_regionkey", "short_words")
cte("quarters", "SELECT CAST(n_nationkey AS VARCHAR) AS nr, w AS name, CAST(n_regionkey AS VARCHAR) AS district, b FROM nation JOIN long_words ON rk = n_nationkey LEFT JOIN bigrams ON item_id = n_nationkey", "long_words", "bigrams")
cte("postcodes", "SELECT DISTINCT CAST(50000 + p_size AS VARCHAR) AS plz, CAST(p_size % 25 AS VARCHAR) AS quarter FROM part WHERE p_size % 7 <> 0")
cte("themes", "SELECT 't' || CAST((rk - 25) // 3 AS VARCHAR) AS key, w AS term FROM long_words WHERE rk >= 25 AND rk < 40", "long_words")
cte("phrases", "SELECT name AS phrase, 'bezirk' AS type, nr AS key FROM districts UNION SELECT name, 'stadtteil', nr FROM quarters UNION SELECT b, 'stadtteil', nr FROM quarters WHERE b IS NOT NULL", "districts", "quarters")


def _ranked(words, cond):
    w = words.filter(cond)
    return w.withColumn("rk", F.row_number().over(Window.orderBy(F.col("c").desc(), "w")) - 1)


def dims(t, streets=None) -> CityDims:
    """Small dimensions from the benchmark words; the windows run over a word list of one small table."""
    words = (t("benchmark").select(F.explode(tokens(norm("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c")))
    long_w, short_w = _ranked(words, "length(w) >= 5"), _ranked(words, "length(w) between 3 and 4")
    x = tokens(norm("text"))
    bigrams = (t("benchmark").filter("item_id < 25").select("item_id", x.alias("x")).filter("size(x) >= 3")
               .select("item_id", F.concat_ws(" ", F.col("x")[1], F.col("x")[2]).alias("b")))
    city = F.lit(CITY).alias("city")
    d = (t("region").join(short_w, F.col("rk") == F.col("r_regionkey"))
         .select(city, F.col("r_regionkey").cast("string").alias("nr"), F.col("w").alias("name"), F.array().cast(NONE).alias("aliases")))
    q = (t("nation").join(long_w, F.col("rk") == F.col("n_nationkey")).join(bigrams, F.col("item_id") == F.col("n_nationkey"), "left")
         .select(city, F.col("n_nationkey").cast("string").alias("nr"), F.col("w").alias("name"), F.col("n_regionkey").cast("string").alias("district"),
                 F.array_compact(F.array("b")).alias("aliases")))
    pc = t("part").filter("p_size % 7 <> 0").select((50000 + F.col("p_size")).cast("string").alias("plz"), (F.col("p_size") % 25).cast("string").alias("quarter")).distinct()
    th = (long_w.filter("rk >= 25 and rk < 40").groupBy(F.floor((F.col("rk") - 25) / 3).alias("i"))
          .agg(F.array_sort(F.collect_list("w")).alias("terms"))
          .select(city, F.concat(F.lit("t"), F.col("i").cast("string")).alias("key"), F.col("i").cast("string").alias("label"), "terms", F.col("i").cast("int").alias("pos")))
    names = t("region").select(F.concat(F.lit("stadt"), F.when(F.col("r_regionkey") > 0, F.col("r_regionkey").cast("string")).otherwise("")).alias("city"),
                               F.when(F.col("r_regionkey") == 0, "Stadt").otherwise(F.col("r_name")).alias("name"), F.array().cast(NONE).alias("aliases"), (F.col("r_regionkey") > 0).alias("on_demand"))
    return CityDims(districts=d, quarters=q, postcodes=pc.select(city, "plz", F.lit("").alias("note")).distinct(),
                    postcode_quarters=pc.select(city, "plz", "quarter"), themes=th, cities=names, streets=streets).settled()


# --- records and places -----------------------------------------------------------

cte("docs", f"""SELECT CAST(doc_id AS VARCHAR) AS id, 'stadt:' || source AS source_id, lang AS kind, split_part(text, chr(10), 1) AS title, text,
  CASE WHEN doc_id % 17 = 0 THEN '' ELSE strftime(DATE '2019-01-01' + CAST(doc_id % 2600 AS INTEGER), '%Y-%m-%d') END AS date,
  {s_norm("text || ' ' || lang")} AS search_text, doc_id % 29 = 0 AS deleted FROM documents""")
cte("records", "SELECT * FROM docs WHERE NOT deleted", "docs")


def all_records(t):
    d = t("documents")
    k = F.col("doc_id")
    return d.select(k.cast("string").alias("id"), F.concat(F.lit("stadt:"), "source").alias("source_id"), F.lit("").alias("reference"), F.col("lang").alias("kind"),
                    F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "text",
                    F.when(k % 17 == 0, "").otherwise(F.date_format(F.date_add(F.lit("2019-01-01").cast("date"), (k % 2600).cast("int")), "yyyy-MM-dd")).alias("date"),
                    norm(F.concat_ws(" ", "text", "lang")).alias("search_text"), (k % 29 == 0).alias("deleted"), F.lit("").alias("web"))


def sources(t):
    return t("documents").select(F.concat(F.lit("stadt:"), "source").alias("id")).distinct().withColumn("city", F.lit(CITY))


def live_records(t):
    from townledger.operators.search import in_scope
    return in_scope(all_records(t), sources(t))


def record_texts(t):
    r = all_records(t).filter("not deleted").withColumn("city", F.lit(CITY))
    return P.texts_of(r, ("title", "betreff"), ("text", "beschreibung"))


def places(t, d=None):
    return P.match_places(record_texts(t), d or dims(t))


cte("texts", "SELECT id, title AS text, 'betreff' AS provenance FROM records UNION ALL SELECT id, text, 'beschreibung' FROM records", "records")
cte("text_norms", f"SELECT id, provenance, text, ' ' || {s_norm('text')} || ' ' AS n FROM texts", "texts")
# A short one-word name needs a word of the text that starts with a capital and has this form.
cte("capital_words", r"""SELECT DISTINCT id, provenance, """ + s_norm("w") + r""" AS phrase FROM (
  SELECT id, provenance, unnest(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda w: regexp_matches(w, '^\p{Lu}') AND length(w) <= 4)) AS w FROM texts)""", "texts")
cte("phrase_hits", """SELECT DISTINCT t.id, t.provenance, p.type, p.key FROM text_norms t JOIN phrases p ON contains(t.n, ' ' || p.phrase || ' ')
  WHERE contains(p.phrase, ' ') OR length(p.phrase) > 4 OR EXISTS (SELECT 1 FROM capital_words c WHERE c.id = t.id AND c.provenance = t.provenance AND c.phrase = p.phrase)""",
    "text_norms", "phrases", "capital_words")
cte("number_hits", r"""SELECT DISTINCT id, provenance, 'plz' AS type, m AS key FROM (SELECT id, provenance, unnest(list_filter(regexp_split_to_array(text, '[^0-9]+'), lambda x: length(x) = 5)) AS m FROM texts) JOIN (SELECT DISTINCT plz FROM postcodes) ON plz = m
  UNION SELECT id, provenance, 'bezirk', m FROM (SELECT id, provenance, unnest(regexp_extract_all(text, '(?i)\bbezirk(?:svertretung)?\s*(\d{1,2})\b', 1)) AS m FROM texts) JOIN districts ON nr = m""", "texts", "postcodes", "districts")
cte("places", """SELECT id, type, key, provenance FROM phrase_hits UNION SELECT id, 'bezirk', q.district, provenance FROM phrase_hits h JOIN quarters q ON h.type = 'stadtteil' AND q.nr = h.key
  UNION SELECT id, type, key, provenance FROM number_hits""", "phrase_hits", "quarters", "number_hits")

# --- requests ----------------------------------------------------------------------

cte("req_words", f"SELECT item_id, list_filter({s_tokens(s_norm('text'))}, lambda w: length(w) >= 6) AS x FROM benchmark")
cte("requests", """SELECT CAST(item_id AS VARCHAR) AS request_id, item_id,
  CASE WHEN item_id % 4 = 0 THEN 'stadtteil' WHEN item_id % 4 = 1 THEN 'bezirk' END AS ptype, CASE WHEN item_id % 4 = 0 THEN CAST(item_id % 25 AS VARCHAR) WHEN item_id % 4 = 1 THEN CAST(item_id % 5 AS VARCHAR) END AS pkey,
  CASE WHEN item_id % 10 = 3 THEN CAST(50000 + item_id % 50 AS VARCHAR) END AS plz, CASE WHEN item_id % 6 = 2 THEN 't' || CAST(item_id % 5 AS VARCHAR) END AS theme,
  CASE WHEN item_id % 3 = 0 THEN [] ELSE list_filter([x[1], x[4], CASE WHEN item_id % 5 = 4 THEN 'qqxqq' END], lambda w: w IS NOT NULL) END AS words,
  CASE WHEN item_id % 5 = 0 THEN '2020-01-01' ELSE '' END AS date_from, CASE WHEN item_id % 7 = 0 THEN '2025-01-01' ELSE '' END AS date_to, item_id % 2 = 0 AS open FROM req_words""", "req_words")


def requests(t, limit=10, offset=0):
    x = F.filter(tokens(norm("text")), lambda w: F.length(w) >= 6)
    i = F.col("item_id")
    place = "array<struct<type:string,key:string>>"
    pl = (F.when(i % 4 == 0, F.array(F.struct(F.lit("stadtteil").alias("type"), (i % 25).cast("string").alias("key"))))
          .when(i % 4 == 1, F.array(F.struct(F.lit("bezirk").alias("type"), (i % 5).cast("string").alias("key")))).otherwise(F.array().cast(place)))
    w = F.array_compact(F.array(F.get("x", 0), F.get("x", 3), F.when(i % 5 == 4, "qqxqq")))
    return t("benchmark").withColumn("x", x).select(
        i.cast("string").alias("request_id"), F.lit(CITY).alias("city"), pl.alias("places"), F.when(i % 10 == 3, (50000 + i % 50).cast("string")).alias("plz"),
        F.when(i % 6 == 2, F.array(F.concat(F.lit("t"), (i % 5).cast("string")))).otherwise(F.array().cast(NONE)).alias("themes"),
        F.when(i % 3 == 0, F.array().cast(NONE)).otherwise(w).alias("words"), F.when(i % 5 == 0, "2020-01-01").alias("date_from"),
        F.when(i % 7 == 0, "2025-01-01").alias("date_to"), (i % 2 == 0).alias("open"), F.lit(limit).alias("limit"), F.lit(offset).alias("offset"))


cte("area", """SELECT request_id, 'stadtteil' AS type, pkey AS key FROM requests JOIN quarters ON nr = pkey WHERE ptype = 'stadtteil'
  UNION SELECT request_id, 'stadtteil', p.quarter FROM requests r JOIN postcodes p ON p.plz = r.plz
  UNION SELECT request_id, 'stadtteil', q.nr FROM requests JOIN districts d ON d.nr = pkey JOIN quarters q ON q.district = d.nr WHERE ptype = 'bezirk'
  UNION SELECT request_id, 'bezirk', pkey FROM requests JOIN districts ON nr = pkey WHERE ptype = 'bezirk'""", "requests", "quarters", "districts", "postcodes")
cte("full_area", """SELECT * FROM area UNION SELECT request_id, 'plz', plz FROM requests WHERE plz IS NOT NULL
  UNION SELECT request_id, 'plz', p.plz FROM area a JOIN postcodes p ON a.type = 'stadtteil' AND a.key = p.quarter""", "area", "requests", "postcodes")
