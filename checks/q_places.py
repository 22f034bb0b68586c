"""Place annotation over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from townledger.operators import places as P
from townledger.operators import tables as T
from townledger.operators.dims import dimension_errors, quarter_postcodes
from townledger.sources import registers as R

from . import bindings as B
from .base import query, s_norm, s_street, with_ctes


@query("gazetteer", with_ctes("phrases", body="SELECT phrase, type, key, CAST(len(string_split(phrase, ' ')) AS INTEGER) AS n_tokens FROM phrases"))
def gazetteer(t):
    return P.build_gazetteer(B.dims(t)).drop("city")


@query("dimension_checks", with_ctes("quarters", "postcodes", body="""SELECT 'postcode with unknown quarter' AS error, quarter AS value, count(*) AS n FROM postcodes WHERE quarter NOT IN (SELECT nr FROM quarters) GROUP BY 1, 2"""))
def dimension_checks(t):
    return dimension_errors(B.dims(t)).groupBy("error", "value").agg(F.count(F.lit(1)).alias("n"))


@query("reverse_postcodes", with_ctes("postcodes", body="SELECT quarter, string_agg(plz, ',' ORDER BY plz) AS postcodes FROM postcodes GROUP BY quarter"))
def reverse_postcodes(t):
    return quarter_postcodes(B.dims(t)).select("quarter", F.array_join("postcodes", ",").alias("postcodes"))


@query("phrase_places", with_ctes("places", body="SELECT id, type, key, provenance FROM places"))
def phrase_places(t):
    return B.places(t).drop("city")


@query("district_rollup", with_ctes("places", body="SELECT key, provenance, count(*) AS n FROM places WHERE type = 'bezirk' GROUP BY key, provenance"))
def district_rollup(t):
    return B.places(t).filter("type = 'bezirk'").groupBy("key", "provenance").agg(F.count(F.lit(1)).alias("n"))


@query("committee_places", with_ctes("text_norms", "phrases", "capital_words", "number_hits", body="""SELECT DISTINCT t.id, p.key, t.provenance FROM text_norms t JOIN phrases p ON p.type = 'bezirk' AND contains(t.n, ' ' || p.phrase || ' ')
  WHERE (length(p.phrase) > 4 OR EXISTS (SELECT 1 FROM capital_words c WHERE c.id = t.id AND c.provenance = t.provenance AND c.phrase = p.phrase))
  UNION SELECT id, key, provenance FROM number_hits WHERE type = 'bezirk'"""))
def committee_places(t):
    """District-only reading, as for committee names."""
    texts = B.record_texts(t).withColumn("districts_only", F.lit(True))
    return P.match_places(texts, B.dims(t)).select("id", "key", "provenance")


@query("structured_places", with_ctes("postcodes", "quarters", body="""SELECT DISTINCT CAST(page_id AS VARCHAR) AS id, 'plz' AS type, plz AS key FROM pages JOIN postcodes ON plz = CAST(50000 + page_id % 60 AS VARCHAR)
  UNION SELECT CAST(page_id AS VARCHAR), 'stadtteil', nr FROM pages JOIN quarters ON nr = CAST(page_id % 40 AS VARCHAR) UNION SELECT CAST(page_id AS VARCHAR), 'bezirk', district FROM pages JOIN quarters ON nr = CAST(page_id % 40 AS VARCHAR)"""))
def structured_places(t):
    d = B.dims(t)
    names = d.quarters.select(F.col("nr"), F.initcap("name").alias("qname"))
    loc = t("pages").select(F.col("page_id").cast("string").alias("id"), (50000 + F.col("page_id") % 60).cast("string").alias("plz"), (F.col("page_id") % 40).cast("string").alias("nr")).join(names, "nr", "left")
    rows = F.array(F.struct(F.lit("plz").alias("type"), F.col("plz").alias("value")), F.struct(F.lit("stadtteil_name").alias("type"), F.coalesce("qname", F.lit("?")).alias("value")))
    loc = loc.select("id", F.explode(rows).alias("r")).select(F.lit(B.CITY).alias("city"), "id", "r.type", "r.value")
    return P.structured_places(loc, d).select("id", "type", "key")


@query("area_expand", with_ctes("full_area", body="SELECT request_id, type, key FROM full_area"))
def area_expand(t):
    return P.expand_area(B.requests(t), B.dims(t)).drop("city")


@query("place_display", with_ctes("places", "quarters", "districts", body="""SELECT id, rank, type, key, name, string_agg(DISTINCT provenance, ',' ORDER BY provenance) AS provenances FROM (
  SELECT p.*, 1 AS rank, q.name FROM places p JOIN quarters q ON p.type = 'stadtteil' AND q.nr = p.key
  UNION ALL SELECT p.*, 2, 'Stadtbezirk ' || d.name FROM places p JOIN districts d ON p.type = 'bezirk' AND d.nr = p.key
    WHERE NOT EXISTS (SELECT 1 FROM places o JOIN quarters q ON o.type = 'stadtteil' AND q.nr = o.key WHERE o.id = p.id AND q.district = p.key)
  UNION ALL SELECT p.*, 3, 'PLZ ' || p.key FROM places p WHERE p.type = 'plz') GROUP BY ALL"""))
def place_display(t):
    d = B.dims(t)
    return P.place_display(B.places(t, d), d).select("id", "rank", "type", "key", "name", F.array_join("provenances", ",").alias("provenances"))


# Street register: names are word pairs and single words of the benchmark, quarters from their items.
REG_SQL = f"""SELECT name, string_agg(DISTINCT q, ',' ORDER BY q) AS quarters, count(DISTINCT q) AS nq FROM (
  SELECT {s_street('g')} AS name, CAST(item_id % 25 AS VARCHAR) AS q FROM (
    SELECT item_id, unnest(list_concat(list_filter(x, lambda w: length(w) >= 6), list_transform(range(1, greatest(len(x), 1)), lambda i: x[i] || ' ' || x[i+1]))) AS g
    FROM (SELECT item_id, list_filter(string_split({s_norm('text')}, ' '), lambda w: w <> '') AS x FROM benchmark))) GROUP BY name"""


def street_register(t):
    from townledger.functions.text import norm, street_key_of_norm, tokens
    x = t("benchmark").select("item_id", tokens(norm("text")).alias("x"))
    grams = F.concat(F.filter("x", lambda w: F.length(w) >= 6), P.ngrams(F.col("x"), 2))
    names = x.select((F.col("item_id") % 25).cast("string").alias("quarter"), F.explode(grams).alias("g")).select(street_key_of_norm("g").alias("name"), "quarter")
    return (names.groupBy("name", "quarter").agg(F.count(F.lit(1)).cast("int").alias("n"))
            .groupBy("name").agg(F.array_sort(F.collect_list(F.struct("quarter", "n"))).alias("quarters"))
            .select(F.lit(B.CITY).alias("city"), "name", "quarters", F.array().cast("array<string>").alias("postcodes")))


# Leftmost-longest choice as a recursion over word positions of each question.
GREEDY = f"""WITH RECURSIVE reg AS ({REG_SQL}),
words AS (SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS id, list_filter(string_split({s_street('n')}, ' '), lambda w: w <> '') AS x FROM (SELECT conv_id, turn, {s_norm('text')} AS n FROM conversations)),
cand AS (SELECT id, i AS pos, l AS len, name FROM (SELECT id, x, unnest(range(1, len(x) + 1)) AS i FROM words) CROSS JOIN (SELECT unnest([1, 2]) AS l)
  JOIN reg ON name = CASE WHEN l = 1 THEN x[i] WHEN i < len(x) THEN x[i] || ' ' || x[i+1] END),
best AS (SELECT id, pos, arg_max(name, len) AS name, max(len) AS len FROM cand GROUP BY id, pos),
walk AS (SELECT id, min(pos) AS pos FROM best GROUP BY id
  UNION ALL SELECT w.id, (SELECT min(n.pos) FROM best n WHERE n.id = w.id AND n.pos >= w.pos + b.len) FROM walk w JOIN best b ON b.id = w.id AND b.pos = w.pos
    WHERE EXISTS (SELECT 1 FROM best n WHERE n.id = w.id AND n.pos >= w.pos + b.len))
"""


def question_texts(t):
    return t("conversations").select(F.lit(B.CITY).alias("city"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit(0).alias("part"), "text",
                                     F.lit("betreff").alias("provenance"), F.lit(False).alias("districts_only"))


@query("greedy_streets", GREEDY + "SELECT w.id, CAST(w.pos AS INTEGER) AS pos, CAST(b.len AS INTEGER) AS len, b.name FROM walk w JOIN best b ON b.id = w.id AND b.pos = w.pos")
def greedy_streets(t):
    return P.match_streets(question_texts(t), street_register(t)).select("id", "pos", "len", "name")


@query("street_places", GREEDY + ", " + with_ctes("quarters", body="").replace("WITH ", "", 1).strip() + """
SELECT DISTINCT w.id, u.type, u.key FROM walk w JOIN best b ON b.id = w.id AND b.pos = w.pos JOIN reg r ON r.name = b.name AND r.nq = 1 JOIN quarters q ON q.nr = r.quarters
  JOIN LATERAL (SELECT 'stadtteil' AS type, q.nr AS key UNION ALL SELECT 'bezirk', q.district) u ON true""")
def street_places(t):
    """Places from streets of exactly one quarter, before texts that name them anyway are considered."""
    d = B.dims(t, street_register(t))
    hits = P.match_streets(question_texts(t), d.streets).join(P.unambiguous_streets(d.streets, d), ["city", "name"])
    return hits.select("id", "type", "key").distinct()


@query("place_diff", with_ctes("places", body="""SELECT id, type, key, 'removed' AS change, count(*) AS n FROM (SELECT id, type, key, provenance FROM places EXCEPT SELECT id, type, key, provenance FROM places WHERE CAST(id AS INTEGER) % 3 <> 0) GROUP BY ALL"""))
def place_diff(t):
    full = B.places(t)
    return T.place_diff(full, full.filter("cast(id as int) % 3 <> 0")).groupBy("id", "type", "key", "change").agg(F.count(F.lit(1)).alias("n"))


# --- registers from a street extract: parts stand for streets ------------------------------------

EXTRACT_SQL = "SELECT p_name || ' Str.' AS name, CAST(10000 + p_size AS VARCHAR) AS plz, p_brand AS suburb, p_type AS borough, CASE WHEN p_partkey % 13 = 0 THEN '2' ELSE '1' END AS ags FROM part"
CLASSED = f"""SELECT {s_street(s_norm('name'))} AS name, plz, suburb, CASE WHEN ags <> '1' THEN 'fremde_gemeinde' WHEN suburb IN ('Brand#1', 'Brand#2') THEN 'unbekannter_stadtteil'
  WHEN plz > '10045' THEN 'ausserhalb_plz' END AS reason FROM ({EXTRACT_SQL})"""


def extract(t):
    return t("part").select(F.concat("p_name", F.lit(" Str.")).alias("Name"), (10000 + F.col("p_size")).cast("string").alias("PostalCode"), F.lit("").alias("Locality"),
                            F.when(F.col("p_partkey") % 13 == 0, "2").otherwise("1").alias("RegionalKey"), F.col("p_type").alias("Borough"), F.col("p_brand").alias("Suburb"))


def classified(t):
    quarters = t("part").filter("p_brand not in ('Brand#1', 'Brand#2')").select(F.col("p_brand").alias("name"), F.col("p_brand").alias("quarter")).distinct()
    plz = t("part").filter("p_size <= 45").select((10000 + F.col("p_size")).cast("string").alias("plz")).distinct()
    return R.classify_streets(extract(t), quarters, plz, "1")


@query("register_rejects", f"SELECT reason, count(*) AS n FROM ({CLASSED}) WHERE reason IS NOT NULL GROUP BY reason")
def register_rejects(t):
    return R.register_counts(classified(t))[2]


@query("register_build", f"""SELECT name, quarters, postcodes FROM (SELECT name, string_agg(suburb || ':' || n, ',' ORDER BY suburb) AS quarters FROM (SELECT name, suburb, count(*) AS n FROM ({CLASSED}) WHERE reason IS NULL GROUP BY 1, 2) GROUP BY name)
  JOIN (SELECT name, string_agg(DISTINCT plz, ',' ORDER BY plz) AS postcodes FROM ({CLASSED}) WHERE reason IS NULL GROUP BY name) USING (name)""")
def register_build(t):
    pq, pp, _ = R.register_counts(classified(t))
    q = F.array_join(F.transform("quarters", lambda x: F.concat_ws(":", x["quarter"], x["n"].cast("string"))), ",")
    return R.build_register(pq, pp).select("name", q.alias("quarters"), F.array_join("postcodes", ",").alias("postcodes"))


@query("register_lines", f"""SELECT a.name || chr(9) || quarters || chr(9) || postcodes AS line FROM (SELECT name, string_agg(suburb || ':' || n, ',' ORDER BY suburb) AS quarters FROM (SELECT name, suburb, count(*) AS n FROM ({CLASSED}) WHERE reason IS NULL GROUP BY 1, 2) GROUP BY name) a
  JOIN (SELECT name, string_agg(DISTINCT plz, ',' ORDER BY plz) AS postcodes FROM ({CLASSED}) WHERE reason IS NULL GROUP BY name) b ON a.name = b.name""")
def register_lines(t):
    pq, pp, _ = R.register_counts(classified(t))
    return R.register_lines(R.build_register(pq, pp)).select("line")


@query("postcode_quarters", f"""SELECT plz, suburb AS quarter, n FROM (SELECT plz, suburb, CAST(sum(n) AS BIGINT) AS n, sum(n) / sum(sum(n)) OVER (PARTITION BY plz) AS share FROM
  (SELECT DISTINCT name, plz FROM ({CLASSED}) WHERE reason IS NULL) p JOIN (SELECT name, left(suburb, 7) AS suburb, count(*) AS n FROM ({CLASSED}) WHERE reason IS NULL GROUP BY 1, 2) q USING (name) GROUP BY plz, suburb) WHERE n >= 3 AND share >= 0.1""")
def postcode_quarters(t):
    """Brands with the same first digit are one quarter."""
    pq, pp, _ = R.register_counts(classified(t))
    pq = pq.groupBy("name", F.substring("quarter", 1, 7).alias("quarter")).agg(F.sum("n").alias("n"))
    return R.postcode_quarters(pq, pp).select("plz", "quarter", "n")


@query("hierarchy_majority", """SELECT CAST(d * 100 + row_number() OVER (PARTITION BY d ORDER BY replace(lower(name), '#', ' '), name) AS VARCHAR) AS nr, name, CAST(d AS VARCHAR) AS district FROM
  (SELECT name, arg_max(d, n * 1000 - d) AS d FROM (SELECT p_brand AS name, rk AS d, count(*) AS n FROM part JOIN (SELECT p_type AS ty, row_number() OVER (ORDER BY p_type) AS rk FROM (SELECT DISTINCT p_type FROM part)) ON ty = p_type GROUP BY 1, 2) GROUP BY name)""")
def hierarchy_majority(t):
    from pyspark.sql import Window
    b = t("part").select(F.col("p_type").alias("borough")).distinct()
    b = b.select("borough", F.row_number().over(Window.orderBy("borough")).alias("nr"), F.col("borough").alias("name"))
    return R.build_hierarchy(extract(t), b)[0]


@query("hierarchy_postcodes", "SELECT CAST(10000 + p_size AS VARCHAR) AS plz, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 10")
def hierarchy_postcodes(t):
    b = t("part").select(F.col("p_type").alias("borough"), F.lit(1).alias("nr"), F.col("p_type").alias("name")).distinct()
    return R.build_hierarchy(extract(t), b)[1]


@query("unmapped_boroughs", "SELECT p_type AS borough, count(*) AS n FROM part WHERE p_type <> 'SMALL' GROUP BY 1")
def unmapped_boroughs(t):
    return R.unmapped_boroughs(extract(t), t("part").filter("p_type = 'SMALL'").select(F.col("p_type").alias("borough")).distinct())
