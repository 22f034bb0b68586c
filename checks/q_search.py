"""Search of many requests over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from townledger.operators import search as S
from townledger.operators import terms as M
from townledger.operators.press import press_lists, press_matches

from . import bindings as B
from .base import cte, query, s_norm, s_tokens, s_variants, with_ctes

V = s_variants("w")
# Every form of every word; words of four letters count for the any-word stage, or all if there are none.
cte("wforms", f"SELECT request_id, i AS no, w, unnest({V}) AS term, w AS n FROM (SELECT request_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM requests)", "requests")
cte("word_hit", "SELECT DISTINCT f.request_id, f.no, r.id FROM wforms f JOIN records r ON contains(r.search_text, f.term)", "wforms", "records")
cte("full_hit", "SELECT DISTINCT f.request_id, f.no, r.id FROM wforms f JOIN records r ON contains(r.search_text, f.n)", "wforms", "records")
cte("theme_hit", "SELECT DISTINCT q.request_id, r.id, max(contains(n.tn, h.term)) AS in_title FROM requests q JOIN themes h ON h.key = q.theme JOIN records r ON contains(r.search_text, h.term) JOIN "
    f"(SELECT id, {s_norm('title')} AS tn FROM records) n ON n.id = r.id GROUP BY 1, 2", "requests", "themes", "records")
cte("place_hit", """SELECT a.request_id, p.id, sum(CASE p.type WHEN 'stadtteil' THEN CASE WHEN provenance = 'betreff' THEN 5 ELSE 3 END WHEN 'bezirk' THEN CASE WHEN provenance = 'betreff' THEN 2 ELSE 1 END
  ELSE CASE WHEN p.key = q.plz THEN 4 ELSE 2 END END) AS points FROM full_area a JOIN places p ON p.type = a.type AND p.key = a.key JOIN requests q ON q.request_id = a.request_id GROUP BY 1, 2""", "full_area", "places", "requests")
cte("shape", """SELECT q.*, EXISTS (SELECT 1 FROM full_area a WHERE a.request_id = q.request_id) AS has_area, EXISTS (SELECT 1 FROM themes h WHERE h.key = q.theme) AS has_theme,
  (ptype IS NOT NULL OR plz IS NOT NULL OR theme IS NOT NULL) AS carried FROM requests q""", "requests", "full_area", "themes")
cte("base", """SELECT s.request_id, s.words, s.carried, s.open, r.id, r.date, coalesce(p.points, 0) AS points, t.id IS NOT NULL AS themed, coalesce(t.in_title, false) AS in_title
  FROM shape s JOIN records r ON (s.date_from = '' OR r.date >= s.date_from) AND (s.date_to = '' OR r.date < s.date_to)
  LEFT JOIN place_hit p ON p.request_id = s.request_id AND p.id = r.id LEFT JOIN theme_hit t ON t.request_id = s.request_id AND t.id = r.id
  WHERE (NOT s.has_area OR p.id IS NOT NULL) AND (NOT s.has_theme OR t.id IS NOT NULL)""", "shape", "records", "place_hit", "theme_hit")
cte("matched", """SELECT b.*, (SELECT count(*) FROM word_hit w WHERE w.request_id = b.request_id AND w.id = b.id) AS nm,
  (SELECT count(*) FROM full_hit w WHERE w.request_id = b.request_id AND w.id = b.id) AS nf FROM base b""", "base", "word_hit", "full_hit")
cte("staged", """SELECT *, 1 AS stage FROM matched WHERE nm = len(words) UNION ALL SELECT *, 2 FROM matched WHERE len(words) > 0 AND carried UNION ALL SELECT *, 3 FROM matched WHERE len(words) >= 2 AND nm > 0""", "matched")
cte("chosen", """SELECT * FROM (SELECT *, min(stage) OVER (PARTITION BY request_id) AS first, row_number() OVER (PARTITION BY request_id, stage ORDER BY date DESC, id) AS candidate_no FROM staged)
  WHERE stage = first""", "staged")
cte("status", "SELECT id, CAST(id AS INTEGER) % 3 <> 0 AS is_open FROM records WHERE CAST(id AS INTEGER) % 2 = 0", "records")
cte("scored", """SELECT c.request_id, c.id, c.date, c.stage, c.candidate_no, count(*) OVER (PARTITION BY c.request_id) AS total,
  c.points + c.nf + CASE WHEN in_title THEN 4 WHEN themed THEN 2 ELSE 0 END + CASE WHEN c.open AND coalesce(s.is_open, true) THEN 3 ELSE 0 END + CASE WHEN c.date <> '' AND c.date >= '2024-10-12' THEN 1 ELSE 0 END AS score
  FROM chosen c LEFT JOIN status s ON s.id = c.id""", "chosen", "status")
cte("ranked", "SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, date DESC, id) AS rank FROM scored", "scored")


def status(t):
    k = F.col("id").cast("int")
    return B.all_records(t).filter("not deleted").filter(k % 2 == 0).select("id", (k % 3 != 0).alias("open"))


def pairs(t):
    d = B.dims(t)
    return S.match_pairs(B.requests(t), B.live_records(t), B.places(t, d), d)


def searched(t, limit=10, offset=0):
    d = B.dims(t)
    out = S.search(B.requests(t, limit, offset), B.live_records(t), B.places(t, d), d, B.TODAY, status(t))
    return out.select("request_id", "id", F.col("rank").cast("long").alias("rank"), "score", "stage", "total")


PAGE = "SELECT request_id, id, rank, CAST(score AS INTEGER) AS score, stage, total FROM ranked WHERE rank > {a} AND rank <= {b}"


@query("search_staged", with_ctes("ranked", body=PAGE.format(a=0, b=10)))
def search_staged(t):
    return searched(t)


@query("page_2", with_ctes("ranked", body=PAGE.format(a=10, b=20)))
def page_2(t):
    return searched(t, 10, 10)


def _stage(t, stage):
    return pairs(t).filter(F.col("stage") == stage).groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.sum("points").alias("points"))


STAGE = "SELECT request_id, count(*) AS n, min(id) AS first_id, CAST(sum(points) AS BIGINT) AS points FROM staged WHERE stage = {s} GROUP BY request_id"


@query("search_and", with_ctes("staged", body=STAGE.format(s=1)))
def search_and(t):
    return _stage(t, S.ALL_WORDS)


@query("search_relaxed", with_ctes("staged", body=STAGE.format(s=2)))
def search_relaxed(t):
    return _stage(t, S.WITHOUT_WORDS)


@query("search_or", with_ctes("staged", body=STAGE.format(s=3)))
def search_or(t):
    return _stage(t, S.ANY_WORD)


@query("candidate_cap", with_ctes("staged", body="""SELECT request_id, id, date, candidate_no, stage FROM (SELECT *, min(stage) OVER (PARTITION BY request_id) AS first,
  row_number() OVER (PARTITION BY request_id, stage ORDER BY date DESC, id) AS candidate_no FROM staged) WHERE stage = first AND candidate_no <= 25"""))
def candidate_cap(t):
    c = S.candidates(pairs(t), cap=25)
    return c.select("request_id", "id", "date", F.col("candidate_no").cast("long").alias("candidate_no"), "stage")


@query("uncapped_totals", with_ctes("staged", body="SELECT request_id, count(*) AS matches FROM (SELECT request_id, stage, min(stage) OVER (PARTITION BY request_id) AS f FROM staged) WHERE stage = f GROUP BY 1"))
def uncapped_totals(t):
    return S.uncapped_totals(pairs(t))


@query("score_rank", with_ctes("scored", body="SELECT request_id, id, CAST(score AS INTEGER) AS score, total FROM scored"))
def score_rank(t):
    return S.score(S.candidates(pairs(t)), status(t), B.TODAY).select("request_id", "id", "score", "total")


@query("search_theme", with_ctes("theme_hit", body="SELECT request_id, id FROM theme_hit"))
def search_theme(t):
    d = B.dims(t)
    terms = S.request_terms(B.requests(t), d).filter("kind = 'theme'")
    hits = M.match_terms(B.live_records(t).select("id", F.col("search_text").alias("text")), terms)
    return hits.join(terms, "term").select("request_id", "id").distinct()


@query("search_range", with_ctes("shape", "records", body="SELECT s.request_id, count(*) AS n FROM shape s JOIN records r ON (s.date_from = '' OR r.date >= s.date_from) AND (s.date_to = '' OR r.date < s.date_to) WHERE len(words) = 0 AND NOT has_area AND NOT has_theme GROUP BY 1"))
def search_range(t):
    """Requests that constrain nothing but the date."""
    d = B.dims(t)
    q = B.requests(t).filter("size(words) = 0 and size(places) = 0 and plz is null and size(themes) = 0")
    return S.range_totals(q, B.live_records(t), d).select("request_id", F.col("matches").alias("n"))


@query("many_terms", f"SELECT term, count(*) AS n, min(id) AS first_id FROM (SELECT DISTINCT unnest({s_tokens(s_norm('text'))}) AS term FROM benchmark) JOIN "
       f"(SELECT conv_id * 100 + turn AS id, {s_norm('text')} AS n FROM conversations) ON contains(n, term) GROUP BY term")
def many_terms(t):
    """Hundreds of terms at once, by way of the vocabulary."""
    from townledger.functions.text import norm, tokens
    terms = t("benchmark").select(F.explode(tokens(norm("text"))).alias("term"))
    texts = t("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), norm("text").alias("text"))
    return M.match_many_terms(texts, terms.distinct()).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("request_terms", with_ctes("wforms", body="SELECT request_id, no, term, term = n AS full_form FROM wforms"))
def request_terms(t):
    terms = S.request_terms(B.requests(t), B.dims(t)).filter("kind = 'word'")
    return terms.select("request_id", F.col("no").cast("long").alias("no"), "term", "full_form").distinct()


@query("record_detail", with_ctes("records", body="SELECT id, source_id FROM records WHERE CAST(id AS INTEGER) % 5 = 0 AND source_id <> 'stadt:src3'"))
def record_detail(t):
    wanted = t("documents").select(F.lit(B.CITY).alias("city"), (F.col("doc_id") * 5).cast("string").alias("id"))
    return S.record_detail(B.all_records(t), B.sources(t).filter("id <> 'stadt:src3'"), wanted).select("id", "source_id")


PRESS = f"SELECT item_id AS pos, list_distinct(list_filter([x[1], x[2]], lambda w: w IS NOT NULL)) AS kw, CAST(item_id * 3 AS VARCHAR) AS ref FROM (SELECT item_id, list_filter({s_tokens(s_norm('text'))}, lambda w: length(w) >= 5) AS x FROM benchmark)"
PRESS_HITS = f"""SELECT r.id, p.pos FROM records r JOIN ({PRESS}) p ON r.id = p.ref OR (len(p.kw) > 0 AND list_bool_and(list_transform(p.kw, lambda k: contains(r.search_text, k))))"""


def press(t):
    from townledger.functions.text import norm, tokens
    x = F.filter(tokens(norm("text")), lambda w: F.length(w) >= 5)
    return t("benchmark").withColumn("x", x).select(
        F.lit(B.CITY).alias("city"), F.col("item_id").alias("pos"), F.lit("Blatt").alias("medium"), F.concat(F.lit("T"), F.col("item_id")).alias("title"), F.lit("https://blatt.example/").alias("url"),
        F.lit("2026-01-02").alias("date"), F.array_compact(F.array(F.get("x", 0), F.get("x", 1))).alias("keywords"), F.array((F.col("item_id") * 3).cast("string")).alias("references"))


def press_records(t):
    return B.live_records(t).withColumn("reference", F.col("id")).withColumn("title", F.lit("")).withColumn("kind", F.lit(""))


@query("press_match", with_ctes("records", body=f"SELECT id, pos FROM ({PRESS_HITS})").replace("r.search_text", "(r.search_text || ' ' || r.id)"))
def press_match(t):
    return press_matches(press_records(t), press(t)).select("id", "pos")


@query("press_lists", with_ctes("records", body=f"SELECT id, string_agg('T' || pos, ',' ORDER BY pos) AS titles, '02.01.2026' AS date_de FROM ({PRESS_HITS}) GROUP BY id").replace("r.search_text", "(r.search_text || ' ' || r.id)"))
def press_list(t):
    lists = press_lists(press_matches(press_records(t), press(t)), press(t))
    return lists.select("id", F.array_join(F.transform("press", lambda p: p["title"]), ",").alias("titles"), F.element_at("press", 1)["date_de"].alias("date_de"))
