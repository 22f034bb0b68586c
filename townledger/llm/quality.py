"""Line-first cleaning: every line is judged by itself, failing lines go, then documents that lose too much text are rejected.

Only column expressions: each document is handled where it is read, nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, split_words

# Fixed values of the line rules.
SEPARATORS = "|»›•"
MARKS = "#*$%&<>!"
TERMINAL = r"[.!?…:;。！？][\"'”’»)\]]*[\x20\x09-\x0D]*$"
BOILERPLATE = (r"(?i)(all rights reserved|licensed under|released under the|cookie policy|accept cookies|use of cookies|privacy policy"
               r"|terms of (use|service)|subscribe to our|sign up for|enable javascript|click here|skip to content|share on (facebook|twitter))")
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_LOST_PERCENT = 50
FRAGMENT_WORDS = 8
REPEAT_WINDOW = 5


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _line(line: Column) -> Column:
    """A line with its words counted and its verdict: navigation, marks, punctuation, boilerplate or none."""
    n, separators, marks = F.regexp_count(line, F.lit(WORD)), _count(line, SEPARATORS), _count(line, MARKS)
    reason = (F.when((separators >= 2) & (separators * 10 >= n), "navigation")
              .when((marks >= 4) & (marks * 2 > n), "marks")
              .when((n < FRAGMENT_WORDS) & ~line.rlike(TERMINAL), "punctuation")
              .when(line.rlike(BOILERPLATE), "boilerplate"))
    return F.struct(line.alias("line"), n.cast("long").alias("n"), reason.alias("reason"))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` from ``_words``: words inside a window of five that occurs twice or more in the text.

    Windows are compared by 64 + 32 bits of two hashes. Where the 64-bit hashes are all different nothing repeats and
    nothing is sorted.
    """
    at = ", ".join(f"element_at(_words, i + {k})" for k in range(REPEAT_WINDOW))
    back = ", ".join(f"element_at(_words, i + {k})" for k in reversed(range(REPEAT_WINDOW)))
    starts = f"sequence(1, size(_words) - {REPEAT_WINDOW - 1})"
    df = df.withColumn("_h", F.expr(f"CASE WHEN size(_words) > {REPEAT_WINDOW} THEN transform({starts}, i -> xxhash64({at})) ELSE array() END"))
    df = df.withColumn("_w", F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN "
                                    f"sort_array(transform({starts}, i -> struct(element_at(_h, i) AS a, hash({back}) AS b, i AS i))) END"))
    same = "element_at(_w, {0}).a = element_at(_w, {1}).a AND element_at(_w, {0}).b = element_at(_w, {1}).b"
    dup = (f"transform(filter(sequence(1, size(_w)), k -> (k > 1 AND {same.format('k', 'greatest(k - 1, 1)')}) "
           f"OR (k < size(_w) AND {same.format('k', 'least(k + 1, size(_w))')})), k -> element_at(_w, k).i)")
    return df.withColumn("n_repeat_words", F.expr(
        f"CASE WHEN _w IS NULL THEN 0L ELSE aggregate(sort_array({dup}), struct(-{REPEAT_WINDOW} AS last, 0L AS total), "
        f"(s, p) -> struct(p AS last, s.total + least({REPEAT_WINDOW}, p - s.last) AS total), s -> s.total) END"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: int = MAX_LOST_PERCENT) -> DataFrame:
    """One row per document: base figures, the lines with their verdicts, the cleaned text and whether it is kept.

    A null text has no words and fails the base rule, as an empty one does. Repeated rows are judged one by one; a null id
    is passed on. Only the two named columns are read, so extra columns of any name are no hindrance. Whole texts of any
    length are judged; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), split_words(text).alias("_words"))
    df = _repeat_words(df)
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_raw", lines).withColumn("lines", F.transform("_raw", _line))
    kept = F.filter("lines", lambda x: x.reason.isNull())
    df = df.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", SPACE, "")).cast("long").alias("word_chars"),
        _count(F.col("_text"), "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("_raw") - F.size(F.array_distinct("_raw"))).cast("long").alias("n_dup_lines"), "n_repeat_words", "lines",
        F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x.n).alias("n_kept_words"),
        F.array_join(F.transform(kept, lambda x: x.line), "\n").alias("clean_text"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost = 100 * (F.col("n_words") - F.col("n_kept_words")) > max_lost * F.col("n_words")
    # a row number is never negative; being no constant it keeps filters on the verdict above this projection, where every
    # figure is worked out once instead of once per mention
    here = F.monotonically_increasing_id() >= 0
    return df.withColumn("base_failed", base_failed & here).withColumn("kept", ~base_failed & ~lost & here)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` whose document is kept, with their cleaned text: lines that fail and blank ones are gone, the others
    are unchanged. ``length_col``, where there is one, is the length of the cleaned text; all other columns are unchanged. No join.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text_col}`").alias("_t"))
    kept = judge(rows, "_row", "_t").filter("kept")
    new = {text_col: F.col("clean_text")}
    if length_col in docs.columns:
        new[length_col] = F.length("clean_text").cast(docs.schema[length_col].dataType)
    return kept.select(*[new.get(c, F.col(f"doc_id.`{c}`")).alias(c) for c in docs.columns])


# The same figures in SQL; word and line rules are stated once more, by unnesting.
SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM t),
win AS (SELECT r, p, ws[p] || ' ' || ws[p+1] || ' ' || ws[p+2] || ' ' || ws[p+3] || ' ' || ws[p+4] AS g
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS p FROM w)),
rep AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p + k) AS n_repeat FROM rep, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY r),
ln AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lf AS (SELECT r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, length(line) - length(translate(line, '{SEPARATORS}', '')) AS seps,
       length(line) - length(translate(line, '{MARKS}', '')) AS marks FROM ln),
lv AS (SELECT r, count(*) - count(DISTINCT line) AS dup, coalesce(sum(n) FILTER (WHERE NOT (
           (seps >= 2 AND seps * 10 >= n) OR (marks >= 4 AND marks * 2 > n)
           OR (n < {FRAGMENT_WORDS} AND NOT regexp_matches(line, '{TERMINAL.replace("'", "''")}'))
           OR regexp_matches(line, '{BOILERPLATE}'))), 0) AS kept_words FROM lf GROUP BY r),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(kept_words, 0) AS BIGINT) AS kept_words
      FROM t JOIN w USING (r) LEFT JOIN cov USING (r) LEFT JOIN lv USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * (n_words - kept_words) > {MAX_LOST_PERCENT} * n_words) AS kept FROM b
"""
