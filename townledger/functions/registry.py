"""Row functions by name for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text
from .html import text_sql

ENDING_SQL = " ".join(
    f"WHEN endswith(w, '{e}') AND length(w) >= {len(e) + text.STEM_MIN} THEN left(w, length(w) - {len(e)})"
    for e in text.ENDINGS)


def register_functions(spark: SparkSession) -> list[str]:
    """Temporary SQL functions ``town_norm``, ``town_street_key``, ``town_stem`` and ``town_html_to_text``."""
    single, forms, marks, longer = text._compatibility_tables()
    spelled = "coalesce(t, '')"
    for old, new in text.UMLAUTS:
        spelled = f"replace({spelled}, '{old}', '{new}')"
    table = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in longer.items()) + ")"
    letters = f"translate(s, '{single + marks}', '{forms}')"
    wide = text._char_class(longer).replace("\\", "\\\\")
    folded = (f"CASE WHEN octet_length(s) = char_length(s) THEN s WHEN s RLIKE '{wide}' THEN "
              f"array_join(transform(split({letters}, ''), c -> coalesce(try_element_at({table}, c), c)), '') "
              f"ELSE {letters} END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION town_fold(s STRING) RETURNS STRING RETURN " + folded)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION town_norm(t STRING) RETURNS STRING RETURN "
              f"trim(regexp_replace(lower(town_fold({spelled})), '[^0-9a-z]+', ' '))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION town_street_key(t STRING) RETURNS STRING RETURN "
              r"regexp_replace(town_norm(t), '\\b([0-9a-z]{2,}|)str\\b', '$1strasse')")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION town_stem(w STRING) RETURNS STRING RETURN CASE {ENDING_SQL} ELSE w END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION town_html_to_text(html STRING) RETURNS STRING RETURN " + text_sql("html"))
    return ["town_norm", "town_street_key", "town_stem", "town_html_to_text"]
