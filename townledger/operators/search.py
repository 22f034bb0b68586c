"""Batch search: a table of requests against a table of records.

Requests: request_id, city, places array<struct<type,key>>, plz, themes array<string>,
words array<string>, date_from, date_to, open, limit, offset.
Records: id, city, date, title, search_text (already in scope, see ``in_scope``).
Places: id, type, key, provenance.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, norm, tokens, variants_of_norm
from ..session import cut_lineage, settled, small_side, worked_out
from . import blocks as B
from .days import DayLists, Status, status_of
from .dims import CityDims
from .places import DISTRICT, POSTCODE, QUARTER, expand_area
from .terms import match_terms
from .topk import SALTS, top_per_group

OR_WORD_MIN = 4
RECENT_DAYS = 730
ALL_WORDS, WITHOUT_WORDS, ANY_WORD = 1, 2, 3
PAIR = ["request_id", "id"]
WORD_BITS = 62
# From so many pairs of a request and a record on, no row is kept per pair, see ``blocks``.
MANY_PAIRS = 50_000_000


def in_scope(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Live records with the city of their source."""
    cities = small_side(sources.select(F.col("id").alias("source_id"), "city"))
    return records.filter(~F.coalesce("deleted", F.lit(False))).drop("city").join(cities, "source_id")


def record_detail(records: DataFrame, sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records by (city, id) if they are live and their source belongs to that city."""
    return in_scope(records, sources).join(wanted.select("city", "id").distinct(), ["city", "id"], "left_semi")


def request_terms(requests: DataFrame, dims: CityDims) -> DataFrame:
    """All terms of the requests: every form of every word, words for the any-word stage, theme terms."""
    words = (requests.select("request_id", "city", F.posexplode("words").alias("no", "word"))
             .withColumn("n", norm("word")))
    forms = words.filter("n <> ''").select("request_id", "city", "no", "n", F.explode(variants_of_norm("n")).alias("term"))
    longer = F.exists("words", lambda w: F.length(norm(w)) >= OR_WORD_MIN)
    has_long = requests.select("request_id", longer.alias("has_long"))
    word_terms = (forms.join(has_long, "request_id")
                  .select("request_id", "city", F.lit("word").alias("kind"), "no", "term",
                          (F.col("term") == F.col("n")).alias("full_form"),
                          ((F.length("n") >= OR_WORD_MIN) | ~F.col("has_long")).alias("any_word")))
    if dims.themes is None:
        return word_terms
    themes = dims.themes.select("city", F.col("key").alias("theme"), "terms")
    theme_terms = (requests.select("request_id", "city", F.explode("themes").alias("theme")).distinct()
                   .join(themes, ["city", "theme"])
                   .select("request_id", "city", F.lit("theme").alias("kind"), F.lit(0).alias("no"),
                           F.explode("terms").alias("term"), F.lit(False).alias("full_form"), F.lit(False).alias("any_word"))
                   .distinct())
    return word_terms.unionByName(theme_terms)


def request_shapes(requests: DataFrame, terms: DataFrame, area: DataFrame) -> DataFrame:
    """What each request constrains: one narrow row per request."""
    with_theme = terms.filter("kind = 'theme'").groupBy("request_id").agg(F.collect_set("term").alias("theme_terms"))
    with_area = area.select("request_id", F.lit(True).alias("has_area")).distinct()
    real = F.size(F.filter("words", lambda w: norm(w) != ""))
    carried = (F.size("places") > 0) | (blank("plz") != "") | (F.size("themes") > 0)
    return (requests.select("request_id", "city", "plz", blank("date_from").alias("date_from"), blank("date_to").alias("date_to"),
                            F.coalesce("open", F.lit(False)).alias("open"), F.col("limit"), F.col("offset"),
                            F.size("words").alias("n_words"), real.alias("n_real"), carried.alias("carried"))
            .join(with_theme, "request_id", "left").join(with_area, "request_id", "left")
            .withColumn("has_area", F.coalesce("has_area", F.lit(False)))
            .withColumn("theme_terms", F.coalesce("theme_terms", F.array().cast("array<string>")))
            .withColumn("has_theme", F.size("theme_terms") > 0)
            .withColumn("scan", ~F.col("has_area") & ~F.col("has_theme") & ((F.col("n_real") == 0) | F.col("carried"))))


def place_points(type_col: str = "type", key_col: str = "key") -> Column:
    """Points of one matching place row: named quarters above districts, the asked postcode above implied ones."""
    named = F.col("provenance") == "betreff"
    return (F.when(F.col(type_col) == QUARTER, F.when(named, 5).otherwise(3))
            .when(F.col(type_col) == DISTRICT, F.when(named, 2).otherwise(1))
            .when(F.col(type_col) == POSTCODE, F.when(F.col(key_col) == F.col("plz"), 4).otherwise(2)))


def in_range(date, date_from, date_to):
    """String comparison; an undated record passes a filter that only has an upper bound."""
    d = F.col(date)
    return ((F.col(date_from) == "") | (d >= F.col(date_from))) & ((F.col(date_to) == "") | (d < F.col(date_to)))


@dataclass(frozen=True)
class Asked:
    """Requests with what they ask for, as small frames."""

    area: DataFrame
    terms: DataFrame
    shapes: DataFrame


def ask(requests: DataFrame, dims: CityDims) -> Asked:
    requests = settled(requests.withColumn("plz", F.nullif(blank("plz"), F.lit(""))))
    area, terms = worked_out(expand_area(requests, dims)), worked_out(request_terms(requests, dims))
    return Asked(area, terms, worked_out(request_shapes(requests, terms, area)))


def pair_rows(asked: Asked, records: DataFrame, places: DataFrame, scans: bool = True) -> DataFrame:
    """Request-record pairs with a bit for each stage they satisfy (1, 2, 4) and their score parts.

    City and date are known on the record's side, so that only hits inside a request's range meet in the one aggregation
    per pair; the records' texts never travel. Without ``scans`` the requests that constrain nothing but the date have no
    pairs of their own, see ``DayLists``.
    """
    ranges = asked.shapes.select("request_id", "plz", "date_from", "date_to")
    # the words of a request as bits of as many numbers as its longest list of words needs, so that partial results are plain numbers
    last = asked.terms.agg(F.max("no")).first()[0] or 0
    blocks = range(last // WORD_BITS + 1)
    masks = [f"{kind}_{b}" for kind in ("word", "full") for b in blocks]
    parts = ("place", "theme", "in_title", "any_word", "points")

    def bit(b, given):
        here = given & (F.floor(F.col("no") / WORD_BITS) == b)
        return F.when(here, F.expr(f"shiftleft(1L, CAST(no % {WORD_BITS} AS INT))"))

    def hits(df, **given):
        return df.filter(in_range("date", "date_from", "date_to")).select(
            *PAIR, "date", *[given.get(p, F.lit(None)).cast("int").alias(p) for p in parts], *[given.get(m, F.lit(None)).cast("long").alias(m) for m in masks])

    narrow = records.select("id", "city", "date")
    placed = (places.select("id", "type", "key", "provenance").join(narrow, "id")
              .join(small_side(asked.area.join(ranges, "request_id")), ["city", "type", "key"]))
    terms = asked.terms.join(ranges, "request_id")
    found = match_terms(records.select("id", "city", "date", F.col("search_text").alias("text")), asked.terms, keep=["city", "date"])
    termed = found.join(small_side(terms), ["city", "term"])
    themes = terms.filter("kind = 'theme'")
    titled = match_terms(records.select("id", "city", "date", norm("title").alias("text")), asked.terms.filter("kind = 'theme'"), keep=["city", "date"])
    is_word = F.col("kind") == "word"
    rows = hits(placed, place=F.lit(1), points=place_points()).unionByName(
        hits(termed, theme=F.when(~is_word, 1), any_word=F.when(F.col("any_word"), 1), **{f"word_{b}": bit(b, is_word) for b in blocks},
             **{f"full_{b}": bit(b, is_word & F.col("full_form")) for b in blocks}))
    rows = rows.unionByName(hits(titled.join(small_side(themes), ["city", "term"]), in_title=F.lit(1)))
    if scans:
        listed = small_side(asked.shapes.filter("scan").select("request_id", "city", "date_from", "date_to"))
        rows = rows.unionByName(hits(narrow.join(listed, "city"), points=F.lit(0)))
    some = lambda c: F.coalesce(F.max(c), F.lit(0)).alias(c)
    number = lambda kind: sum((F.bit_count(f"{kind}_{b}") for b in blocks), F.lit(0)).alias(f"n_{kind}")
    # a record has one date; as a key it leaves numbers only to aggregate, which needs no sort
    pairs = (rows.groupBy(*PAIR, "date").agg(
        some("place"), some("theme"), some("in_title"), some("any_word"), F.coalesce(F.sum("points"), F.lit(0)).alias("points"),
        *[F.coalesce(F.bit_or(m), F.lit(0)).alias(m) for m in masks])
        .select(*PAIR, "date", "place", "theme", "in_title", "any_word", "points", number("word").alias("n_matched"), number("full").alias("n_full")))
    shapes = small_side(asked.shapes.select("request_id", "city", "n_words", "n_real", "carried", "has_area", "has_theme", F.col("open").alias("open_asked")))
    base = (~F.col("has_area") | (F.col("place") == 1)) & (~F.col("has_theme") | (F.col("theme") == 1))
    bits = (F.when(F.col("n_matched") == F.col("n_real"), 1).otherwise(0) + F.when((F.col("n_words") > 0) & F.col("carried"), 2).otherwise(0)
            + F.when((F.col("n_words") >= 2) & (F.col("any_word") == 1), 4).otherwise(0))
    return (pairs.join(shapes, "request_id").filter(base).withColumn("stages", bits).filter("stages > 0")
            .select(*PAIR, "city", "date", "points", (F.col("n_full") + F.col("n_words") - F.col("n_real")).alias("word_points"),
                    F.when(~F.col("has_theme"), 0).when(F.col("in_title") == 1, 4).otherwise(2).alias("theme_points"), "open_asked", "stages"))


def match_pairs(requests: DataFrame, records: DataFrame, places: DataFrame, dims: CityDims) -> DataFrame:
    """All request-record pairs, a row for each stage they satisfy."""
    each = F.array_compact(F.array(*[F.when(F.col("stages").bitwiseAND(F.lit(1 << n)) > 0, n + 1) for n in range(3)]))
    return pair_rows(ask(requests, dims), records, places).withColumn("stage", F.explode(each)).drop("stages")


def candidates(pairs: DataFrame, cap: int | None = None) -> DataFrame:
    """All pairs of the first stage that finds anything, with their total; ``cap`` keeps the newest so many only.

    The first stage and the total come from one count per request and stage, so that no request's pairs meet in one task.
    """
    if cap is None:
        pairs = cut_lineage(pairs)  # read by the counts and by the choice
        counts = pairs.groupBy("request_id", "stage").agg(F.count(F.lit(1)).alias("n"))
        first = counts.groupBy("request_id").agg(F.min("stage").alias("stage"), F.min_by("n", "stage").alias("total"))
        df = pairs.join(small_side(first), ["request_id", "stage"]).withColumn("capped", F.lit(False))
    else:
        order = [F.col("date").desc(), F.col("id")]
        picked = top_per_group(pairs, ["request_id", "stage"], order, cap, salt_by=["id"], rank="candidate_no")
        per_request = Window.partitionBy("request_id")
        df = (picked.withColumn("_first", F.min("stage").over(per_request)).filter("stage = _first").drop("_first")
              .withColumn("total", F.count(F.lit(1)).over(per_request)).withColumn("capped", F.col("total") >= cap))
    return with_stage_flags(df)


def with_stage_flags(df: DataFrame) -> DataFrame:
    return df.withColumn("words_dropped", F.col("stage") == WITHOUT_WORDS).withColumn("any_word_used", F.col("stage") == ANY_WORD)


def uncapped_totals(pairs: DataFrame) -> DataFrame:
    """Number of matches of the chosen stage per request, without the candidate cap."""
    counts = pairs.groupBy("request_id", "stage").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("request_id").agg(F.min_by("n", "stage").alias("matches"))


def range_totals(requests: DataFrame, records: DataFrame, dims: CityDims) -> DataFrame:
    """Number of matches of the requests that constrain nothing but the date, from counts per day."""
    return DayLists(records, ask(requests, dims).shapes.filter("scan")).totals().filter("matches > 0")


def score(cands: DataFrame, status: Status | None, today) -> DataFrame:
    """Points of each candidate: places, theme in title or text, words, open status, recency.

    Only candidates of requests that ask for open records look at the status; ``is_open`` of a candidate may be given.
    """
    df = cands if "is_open" in cands.columns else cands.withColumn("is_open", F.lit(None).cast("boolean"))
    if status is not None:
        unknown = F.col("open_asked") & F.col("is_open").isNull()
        states = status_of(status, df.filter(unknown)).select("id", F.col("open").alias("_open"))
        df = (df.filter(unknown).join(states, "id", "left").withColumn("is_open", F.col("_open")).drop("_open")
              .unionByName(df.filter(~unknown)))
    recent_from = _recent_from(today)
    points = (F.col("points") + F.col("word_points") + F.col("theme_points")
              + F.when(F.col("open_asked") & F.coalesce("is_open", F.lit(True)), 3).otherwise(0)
              + F.when((F.col("date") != "") & (F.col("date") >= recent_from), 1).otherwise(0))
    return df.withColumn("score", points.cast("int")).drop("open_asked", "is_open", "theme_points")


def page(scored: DataFrame, requests: DataFrame) -> DataFrame:
    """The asked page per request: score, then date, then id.

    Slices of a request are ranked first and keep what its page can need, so a request that matches a large share of all
    records is not sorted in one task.
    """
    order = [F.col("score").desc(), F.col("date").desc(), F.col("id")]
    window = small_side(requests.select("request_id", F.col("limit").alias("_limit"), F.col("offset").alias("_offset")))
    sliced = Window.partitionBy("request_id", "_slice").orderBy(*order)
    df = (scored.join(window, "request_id").withColumn("_slice", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
          .withColumn("_pick", F.row_number().over(sliced)).filter(F.col("_pick") <= F.col("_offset") + F.col("_limit")))
    return (df.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(*order)))
            .filter((F.col("rank") > F.col("_offset")) & (F.col("rank") <= F.col("_offset") + F.col("_limit")))
            .drop("_limit", "_offset", "_slice", "_pick"))


def best_rows(asked: Asked, records: DataFrame, places: DataFrame, today, status: Status | None = None, size: int = B.BLOCK, part: int = B.PART, step: int = B.STEP) -> DataFrame:
    """Candidates that can stand on the pages, with stage and total, from blocks of records and requests."""
    shapes = asked.shapes
    areas = worked_out(asked.area.select("type", "key").distinct().withColumn("code", F.monotonically_increasing_id()))
    word = F.struct("no", "term", "full_form", "any_word")
    terms = asked.terms.filter("term <> ''")
    words = terms.filter("kind = 'word'").groupBy("request_id").agg(F.array_sort(F.collect_set(word)).alias("words"))
    themes = terms.filter("kind = 'theme'").groupBy("request_id").agg(F.collect_set("term").alias("themes"))
    coded = asked.area.join(small_side(areas), ["type", "key"]).join(shapes.select("request_id", "plz"), "request_id")
    weight = F.when(F.col("type") != POSTCODE, 1).when(F.col("key") == F.col("plz"), 4).otherwise(2)
    area = (coded.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("code", weight.alias("weight")))).alias("x"))
            .select("request_id", F.col("x.code").alias("area"), F.col("x.weight").alias("weights")))
    lists = shapes.select("request_id", "city", "date_from", "date_to", "open", "n_words", "n_real", "carried", "has_area", "has_theme",
                          (F.col("limit") + F.col("offset")).alias("need")).filter("need > 0")
    known = lists.agg(F.count(F.lit(1)).alias("n"), F.sum("need").alias("need")).first()
    parts = max(1, -(-known.n // part), -(-(known.need or 0) // B.PART_ROWS))
    lists = lists.join(words, "request_id", "left").join(themes, "request_id", "left").join(area, "request_id", "left")
    empty = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    lists = lists.select(*[c for c in lists.columns if c not in ("words", "themes", "area", "weights")],
                         *[F.coalesce(F.col(f"words.{c}"), F.array().cast(f"array<{t}>")).alias(name) for name, c, t in
                           (("nos", "no", "int"), ("terms", "term", "string"), ("full", "full_form", "boolean"), ("any", "any_word", "boolean"))],
                         empty("themes", "array<string>"), empty("area", "array<bigint>"), empty("weights", "array<int>"))
    # where no term has several words, the words of a text say all
    whole = bool(terms.filter(F.contains("term", F.lit(" "))).limit(1).count())
    text = F.col("search_text") if whole else F.array_join(F.array_sort(F.array_distinct(tokens("search_text"))), " ")
    texts = records.select("id", "city", "date", text.alias("text"), norm("title").alias("title"))
    blocks = worked_out(B.block_counts(records.select("city", F.col("search_text").alias("text")), size, parts).join(shapes.select("city").distinct(), "city", "left_semi"))
    rows = B.with_block(texts, blocks)
    narrow = rows.select("id", *B.BLOCK_KEY).filter("id IS NOT NULL").distinct()
    placed = (places.select("id", "type", "key", "provenance").join(small_side(areas), ["type", "key"]).join(narrow, "id")
              .select("id", *B.BLOCK_KEY, "code", B.place_values().alias("points")))
    with_status = status is not None and bool(shapes.filter("open").limit(1).count())
    # without a status a record is open if anyone asks, and its status is unknown
    found = B.as_rows(rows.withColumn("is_open", F.lit(True if with_status else None).cast("boolean")), B.RECORD).unionByName(B.as_rows(placed, B.PLACE))
    if with_status:
        closed = status_of(status, rows).filter("NOT open").select("id", F.col("open").alias("is_open"))
        found = found.unionByName(B.as_rows(narrow.join(closed, "id"), B.OPEN))
    best = B.pick_rows(found, lists, blocks, _recent_from(today), parts, step)
    # of a request's first stage the rows its page can need, in the order of ``page``
    each = Window.partitionBy("request_id")
    best = best.withColumn("_first", F.min("stage").over(each)).filter("stage = _first").withColumn("total", F.sum("n").over(each))
    best = best.withColumn("_no", F.row_number().over(each.orderBy(F.col("score").desc(), F.col("date").desc(), "id")))
    wanted = small_side(shapes.select("request_id", (F.col("limit") + F.col("offset")).alias("_need")))
    return cut_lineage(best.join(wanted, "request_id").filter("_no <= _need").drop("n", "score", "_first", "_no", "_need"))


def _recent_from(today) -> str:
    return str(date.fromisoformat(str(today)[:10]) - timedelta(days=RECENT_DAYS))


def search(requests: DataFrame, records: DataFrame, places: DataFrame, dims: CityDims, today,
           status: Status | None = None, cap: int | None = None, many: int = MANY_PAIRS) -> DataFrame:
    """Staged, filtered, ranked pages for all requests: request_id, id, rank, score, stage, total and flags.

    ``status`` has id and open, or is a function from a frame of ids to such a frame, which then sees candidates only.

    The pairs are worked out once and kept as narrow rows. Requests that constrain nothing but the date have no pairs: their
    totals come from counts per day, their pages from the first rows of the days they reach. From ``many`` pairs of a request and
    a record on, pairs are worked out in blocks and only what a page can need is kept.
    """
    requests, dims = settled(requests), dims.settled()
    if cap is not None:
        return page(score(candidates(match_pairs(requests, records, places, dims), cap), status, today), requests)
    asked = ask(requests, dims)
    worded = asked.shapes.filter("NOT scan OR n_real > 0")
    if worded.count() * records.count() >= many:
        cands = best_rows(Asked(asked.area, asked.terms, worked_out(worded)), records, places, today, status)
        plain = worked_out(asked.shapes.filter("scan AND n_real = 0"))
        if plain.limit(1).count():
            days = DayLists(records, plain, status)
            totals = small_side(days.totals().filter("matches > 0").select("request_id", F.lit(ALL_WORDS).alias("stage"), F.col("matches").alias("total")))
            cands = cands.unionByName(days.pages().join(totals, "request_id").withColumns({"points": F.lit(0).cast("long"), "theme_points": F.lit(0)}))
        return page(score(cut_lineage(with_stage_flags(cands.withColumn("capped", F.lit(False)))), status, today), requests)
    pairs = cut_lineage(pair_rows(asked, records, places, scans=False))
    days = DayLists(records, asked.shapes.filter("scan"), status)
    of_bit = lambda n: F.sum(F.when(F.col("stages").bitwiseAND(F.lit(1 << n)) > 0, 1).otherwise(0))
    counts = pairs.groupBy("request_id").agg(*[of_bit(n).alias(f"n{n + 1}") for n in range(3)])
    # what a scan finds are all records of the range: in the first stage without words, else in the one that drops them
    ranged = days.totals().select("request_id", "matches", F.when(F.col("n_real") == 0, ALL_WORDS).otherwise(WITHOUT_WORDS).alias("scan_stage"))
    each = asked.shapes.select("request_id").join(counts, "request_id", "left").join(ranged, "request_id", "left")
    n = [F.greatest(F.coalesce(f"n{k}", F.lit(0)), F.when(F.col("scan_stage") == k, F.col("matches")).otherwise(0)) for k in (1, 2, 3)]
    stage = F.when(n[0] > 0, ALL_WORDS).when(n[1] > 0, WITHOUT_WORDS).when(n[2] > 0, ANY_WORD)
    total = F.when(n[0] > 0, n[0]).when(n[1] > 0, n[1]).otherwise(n[2]).cast("long")
    first = settled(each.select("request_id", "scan_stage", stage.alias("stage"), total.alias("total")).filter("stage IS NOT NULL"))
    chosen = small_side(first.select("request_id", "stage", "total"))
    found = (pairs.join(chosen, "request_id").filter(F.col("stages").bitwiseAND(F.expr("shiftleft(1, stage - 1)")) > 0)
             .drop("stages").withColumn("is_open", F.lit(None).cast("boolean")))
    # a hit that is listed too keeps its row with points for words
    listed = days.pages().join(small_side(first.filter("stage = scan_stage").select("request_id", "stage", "total")), "request_id")
    listed = listed.join(pairs.select(*PAIR), PAIR, "left_anti").select(
        *PAIR, "city", "date", F.lit(0).alias("points"), "word_points", F.lit(0).alias("theme_points"), "open_asked", "is_open", "stage", "total")
    # read by the status, the rows with a status and those without
    cands = cut_lineage(with_stage_flags(found.unionByName(listed).withColumn("capped", F.lit(False))))
    return page(score(cands, status, today), requests)
