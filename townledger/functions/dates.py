"""ISO strings, German display dates and Berlin moments.

Dates stay strings beside typed values because blank and date-only values carry meaning.
Moments are parsed with an explicit zone, so the results do not depend on the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, blank, let

ZONE = "Europe/Berlin"
ISO_SHAPE = (r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?"
             r"(Z|[+-]\d{2}(:?\d{2})?)?)?$")


def date_de(col) -> Column:
    """``YYYY-MM-DD…`` as ``DD.MM.YYYY``; anything else is blank."""
    c = blank(col)
    ok = (F.length(c) >= 10) & (F.substring(c, 5, 1) == "-")
    return F.when(ok, F.concat_ws(".", F.substring(c, 9, 2), F.substring(c, 6, 2), F.substring(c, 1, 4))).otherwise("")


def parse_date(col) -> Column:
    """Leading ISO day, else the first German date, else blank."""
    german = r"(?<![\p{L}\p{N}_])(\d{1,2}\.\d{1,2}\.\d{4})(?![\p{L}\p{N}_])"

    def first_german(c: Column) -> Column:
        # the day as written, its parts in turn; no date gives one empty part
        day = let(F.split(F.regexp_extract(c, german, 1), r"\."), lambda d: F.when(F.size(d) < 3, "").otherwise(
            F.concat_ws("-", F.get(d, 2), F.lpad(F.get(d, 1), 2, "0"), F.lpad(F.get(d, 0), 2, "0"))))
        return F.when(F.contains(c, F.lit(".")), day).otherwise("")

    def read(c: Column) -> Column:
        return let(F.regexp_extract(F.trim(c), r"^(\d{4}-\d{2}-\d{2})", 1), lambda iso: F.when(iso != "", iso).otherwise(first_german(c)))

    return let(blank(col), read)


def moment(col, end: bool = False) -> Column:
    """Instant of an ISO text; a date-only end lasts to the end of its day, naive times are Berlin time."""
    given = c = F.replace(F.trim(blank(col)), F.lit(" "), F.lit("T"))
    day_only = ~F.contains(given, F.lit("T"))
    for short in (r"(T\d{2})(?=$|Z|[+-])", r"(T\d{2}:\d{2})(?=$|Z|[+-])"):
        c = F.regexp_replace(c, short, "$1:00")
    c = F.when(day_only, given).otherwise(c)  # the patterns need a time
    zoned = c.rlike(r"T.*(Z|[+-]\d{2}(:?\d{2})?)$")
    last = "23:59:59.999999" if end else "00:00:00"
    text = (F.when(day_only, F.concat(c, F.lit(f"T{last} {ZONE}")))
            .when(zoned, c)
            .otherwise(F.concat(c, F.lit(f" {ZONE}"))))
    return F.when(c.rlike(ISO_SHAPE), text.try_cast("timestamp"))


def local_time(ts) -> Column:
    """Berlin wall clock of an instant."""
    return F.convert_timezone(None, F.lit(ZONE), _c(ts).cast("timestamp_ntz"))


def local_day(ts) -> Column:
    """Berlin calendar day of an instant as ISO text, blank when unknown."""
    return F.coalesce(F.date_format(local_time(ts), "yyyy-MM-dd"), F.lit(""))


def moment_de(col) -> Column:
    """Display form in Berlin time; date-only values stay without a time."""
    c = blank(col)
    timed = F.contains(c, F.lit("T")) | F.contains(c, F.lit(" "))
    shown = F.date_format(local_time(moment(c)), "dd.MM.yyyy, HH:mm")
    return (F.when(timed, F.coalesce(F.concat(shown, F.lit(" Uhr")), F.lit("")))
            .when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), date_de(c)).otherwise(""))


def since(col, today) -> Column:
    """``90d`` is a rolling date, a date stays, blank is null."""
    c = F.trim(blank(col))
    days = F.regexp_extract(c, r"^(\d+)[dD]$", 1)
    rolled = F.date_format(F.date_sub(F.lit(today).cast("date"), days.try_cast("int")), "yyyy-MM-dd")
    return F.when(c == "", F.lit(None).cast("string")).when(days != "", rolled).otherwise(c)
