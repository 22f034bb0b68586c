"""RSS feeds: session and press hints. Feeds: source_id, url, kind ('sitzungen' or 'presse'), body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import html_to_text
from ..functions.text import blank, collapse_ws, truncate_text
from ..functions.urls import host, path, scheme

CHANNEL = ("channel struct<title:string,item:array<struct<title:string,link:string,description:string,pubDate:string,guid:string>>>")
SESSION_TITLE = r"^(.+?)\s*\|\s*(\d{2}\.\d{2}\.\d{4})\s*-\s*(\d{1,2}:\d{2})\s*\(Sitzung\s+([^)]+?)\s*\)"


def feed_items(feeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of sound feeds with a verdict, and failed feeds with the reason.

    A feed fails as a whole if it is not rss/channel/title; its size does not matter.
    """
    rooted = F.regexp_replace("body", r"^\s*<\?xml[^>]*\?>", "").rlike(r"(?s)^\s*(<!--.*?-->\s*)*<rss[\s>]")
    df = feeds.withColumn("_f", F.from_xml("body", CHANNEL, {"ignoreNamespace": "true", "mode": "PERMISSIVE"}))
    error = (F.when(~rooted | F.col("_f.channel").isNull(), "no rss channel")
             .when(F.trim(blank("_f.channel.title")) == "", "no channel title"))
    df = df.withColumn("error", error)
    failed = df.filter("error is not null").select("source_id", "url", "error")
    items = (df.filter("error is null").select("source_id", "url", "kind", F.posexplode("_f.channel.item").alias("pos", "i"))
             .select("source_id", "url", "kind", "pos", F.trim(blank("i.title")).alias("title"), F.trim(blank("i.link")).alias("link"),
                     blank("i.description").alias("description"), F.trim(blank("i.pubDate")).alias("pub_date"), F.trim(blank("i.guid")).alias("guid")))
    own = (scheme("link") == "https") & (host("link") == host("url")) & (path("link") != "")
    return items.withColumn("own_link", own & (F.col("title") != "")), failed


def _table_cell(label: str) -> Column:
    """Text of the cell next to the cell with this label in the description's table."""
    pattern = rf"(?is)<tr\b[^>]*>\s*<td\b[^>]*>\s*{label}\s*:?\s*</td>\s*<td\b[^>]*>(.*?)</td>"
    return F.regexp_extract("description", pattern, 1)


def session_hints(items: DataFrame) -> DataFrame:
    """Session dates; other titles of the same feed get ``ok`` false."""
    df = items.withColumn("_t", collapse_ws("title"))
    g, day, time, nr = (F.trim(F.regexp_extract("_t", SESSION_TITLE, i)) for i in (1, 2, 3, 4))
    date = F.try_to_date(day, "dd.MM.yyyy")
    si = F.regexp_extract("link", r"[?&]si(\d+)\b", 1)
    df = df.withColumn("_place", html_to_text(_table_cell("Ort"))).withColumn("_com", html_to_text(_table_cell("Gremium")))
    lead = html_to_text(F.regexp_extract("description", r"(?s)^([^<]*)", 1))
    return df.withColumn("_lead", lead).select(
        "source_id", "url", (F.col("own_link") & (nr != "") & date.isNotNull()).alias("ok"), F.concat(F.lit("sitzung:"), nr).alias("id"),
        F.lit("Sitzungstermin").alias("kind"), F.concat(g, F.lit(" – Sitzung "), nr).alias("title"),
        F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit("")).alias("date"), time.alias("time"), F.col("_place").alias("place"),
        F.coalesce(F.nullif("_com", F.lit("")), g).alias("committee"), F.col("link").alias("web"), truncate_text("_lead").alias("short_text"),
        F.when(si != "", F.concat(F.lit("meetings/"), si)).otherwise("").alias("refers_to"))


def local_pub_date(c) -> Column:
    """The feed's own calendar day of an RFC 822 date; the zone is not converted."""
    bare = F.regexp_replace(blank(c), r"^\s*[A-Za-z]{3,9},?\s*", "")
    day = F.regexp_extract(bare, r"^(\d{1,2} [A-Za-z]{3} \d{4})\b", 1)
    return F.coalesce(F.date_format(F.try_to_date(F.nullif(day, F.lit("")), "d MMM yyyy"), "yyyy-MM-dd"), F.lit(""))


def press_hints(items: DataFrame) -> DataFrame:
    date = local_pub_date("pub_date")
    df = items.withColumn("_d", date).withColumn("_text", html_to_text("description"))
    none = F.lit("")
    return df.select("source_id", "url", (F.col("own_link") & (F.col("_d") != "")).alias("ok"),
                     F.coalesce(F.nullif("guid", none), F.col("link")).alias("id"), F.lit("Pressemitteilung").alias("kind"),
                     F.substring(collapse_ws("title"), 1, 300).alias("title"), F.col("_d").alias("date"), none.alias("time"), none.alias("place"),
                     none.alias("committee"), F.col("link").alias("web"), truncate_text("_text").alias("short_text"), none.alias("refers_to"))


def hints(feeds: DataFrame, loaded) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hint rows, rejected counts per source, failed feeds."""
    items, failed = feed_items(feeds)
    both = session_hints(items.filter("kind = 'sitzungen'")).unionByName(press_hints(items.filter("kind = 'presse'")))
    rejected = both.groupBy("source_id").agg(F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("rejected"))
    rows = both.filter("ok").drop("ok", "url").withColumn("loaded", F.lit(loaded))
    return rows, rejected, failed
