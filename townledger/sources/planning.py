"""Land-use plan procedures: strict list pages and stored detail pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import moment
from ..functions.html import anchors, html_to_text_array, live_markup
from ..functions.rules import phase_label
from ..functions.text import blank, norm
from ..functions.urls import resolve_url
from ..operators.topk import first_per_key

PROCEDURE_ID = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,127}$"
PLACEHOLDER_YEAR = 1971
ATTRIBUTES = ("externalName string, externalDescription string, externalStartDate string, externalEndDate string, externalPhaseTranslationKey string, "
              "externalPhaseDefinitionName string, externalPhasePermissionset string, owningOrganisationName string")
TEXT_FIELDS = ("externalName", "externalDescription", "owningOrganisationName", "externalPhaseDefinitionName", "externalPhaseTranslationKey")


def period_day(c) -> Column:
    """A participation date as given; an obvious placeholder is blank."""
    c = blank(c)
    year = F.substring(c, 1, 4).try_cast("int")
    return F.when((c == "") | (year < PLACEHOLDER_YEAR), "").otherwise(c)


def period_error(begin, end) -> Column:
    """Why a period is unusable, or null."""
    b, e = blank(begin), blank(end)
    bad = ((b != "") & moment(b).isNull()) | ((e != "") & moment(e).isNull())
    reversed_ = (period_day(b) != "") & (period_day(e) != "") & (moment(e, end=True) < moment(b))
    return F.when(bad, "invalid participation date").when(reversed_, "end of participation before its begin")


def planning_procedures(pages: DataFrame, organisation: str, template: str) -> tuple[DataFrame, DataFrame]:
    """Procedure rows of sound pages, and the rejected pages with the reason.

    pages: source_id, url, page_no, body. An unknown shape is an error of the whole page, never an
    empty list. The last row per address counts.
    """
    env = F.from_json("body", "data array<string>, errors string, meta string, links string")
    df = pages.withColumn("_e", env)
    raw_data = F.get_json_object("body", "$.data")
    shape_ok = F.col("_e").isNotNull() & raw_data.isNotNull() & F.startswith(F.ltrim(raw_data), F.lit("["))
    api_error = F.coalesce(~F.coalesce("_e.errors", F.lit("")).isin("", "[]", "{}", "null"), F.lit(False)) | (
        ~F.coalesce(F.get_json_object("body", "$.meta.messages.error"), F.lit("[]")).isin("", "[]", "{}", "null"))
    objs = F.transform(F.coalesce("_e.data", F.array().cast("array<string>")), lambda o: F.struct(
        F.get_json_object(o, "$.type").alias("type"), F.get_json_object(o, "$.id").alias("id"),
        F.from_json(F.get_json_object(o, "$.attributes"), ATTRIBUTES).alias("a")))
    # the texts of an object stay with it, so that each is worked out once
    read = F.transform(objs, lambda o: F.struct(o["type"].alias("type"), o["id"].alias("id"), o["a"].alias("a"),
                                                html_to_text_array(F.array(*[F.coalesce(o["a"][f], F.lit("")) for f in TEXT_FIELDS])).alias("t")))
    df = df.withColumn("_o", read)

    def row(o, i):
        a = o["a"]

        def text(field):
            return F.coalesce(F.get(o["t"], TEXT_FIELDS.index(field)), F.lit(""))

        permission = F.coalesce(a["externalPhasePermissionset"], F.lit(""))
        org, title = text("owningOrganisationName"), text("externalName")
        visible = permission.isin("", "read", "write")
        mine = F.lit(not organisation) | (org == F.lit(organisation)) | (norm(org) == norm(F.lit(organisation)))
        taken = visible & mine
        error = (F.when((F.coalesce(o["type"], F.lit("")) != "Procedure") | a.isNull(), "unexpected procedure object")
                 .when(~visible, F.lit(None).cast("string"))
                 .when(F.lit(bool(organisation)) & (org == ""), "organisation missing")
                 .when(~mine, F.lit(None).cast("string"))
                 .when(~F.coalesce(o["id"], F.lit("")).rlike(PROCEDURE_ID), "invalid procedure id")
                 .when(title == "", "public title missing")
                 .otherwise(period_error(a["externalStartDate"], a["externalEndDate"])))
        return F.struct(
            i.alias("pos"), taken.alias("taken"), error.alias("error"),
            F.replace(F.lit(template), F.lit("{id}"), F.coalesce(o["id"], F.lit(""))).alias("id"), title.alias("title"),
            phase_label(text("externalPhaseDefinitionName"), text("externalPhaseTranslationKey")).alias("phase"),
            period_day(a["externalStartDate"]).alias("begin"), period_day(a["externalEndDate"]).alias("end"),
            text("externalDescription").alias("description"), org.alias("organisation"), permission.alias("permission"))

    # a generated column: filters on what it holds stay above it, so that no page is worked out again for them
    df = df.select("source_id", "url", "page_no", shape_ok.alias("_shape_ok"), api_error.alias("_api_error"), F.explode(F.array(F.transform("_o", row))).alias("_r"))
    row_error = F.element_at(F.concat(F.filter(F.transform("_r", lambda r: r["error"]), lambda e: e.isNotNull()), F.array(F.lit(None).cast("string"))), 1)
    df = df.withColumn("error", F.when(~F.col("_shape_ok"), "no procedure list in the answer").when(F.col("_api_error"), "interface reports an error").otherwise(row_error))
    rejects = df.filter("error is not null").select("source_id", "url", "page_no", "error")
    rows = (df.filter("error is null").select("source_id", "url", "page_no", F.explode("_r").alias("r")).filter("r.taken")
            .select("source_id", "page_no", "r.*").drop("taken", "error"))
    return first_per_key(rows, ["id"], [F.col("page_no").desc(), F.col("pos").desc()]), rejects


def next_list_page(pages: DataFrame) -> DataFrame:
    """Following list page: a plain link or a link object; it must stay on the same search address."""
    raw = F.get_json_object("body", "$.links.next")
    link = F.when(F.startswith(raw, F.lit("{")), F.get_json_object(raw, "$.href")).otherwise(raw)
    target = resolve_url(link, F.col("url"))
    bare = "[?#].*$"
    same = F.regexp_replace(target, bare, "") == F.regexp_replace("url", bare, "")
    return pages.select("url", F.when(blank(link) == "", "").when(same, target).alias("next_url"))


# Marks of a public detail page, and of a login form.
PUBLIC_MARK = r"""(?is)<[a-z][^>]*\sid\s*=\s*["']?(?:infolistContentMetaDescription|helpPublicDetailTimelimit)(?=["'\s>])"""
LOGIN_MARK = r"""(?is)<input\s[^>]*?type\s*=\s*["']?password(?=["'\s/>])"""


def page_document_links(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of stored detail pages (record_id, url, html), and a status per page.

    The last named anchor per address counts; a generic one never replaces it.
    """
    marks = pages.withColumn("_m", live_markup("html"))
    public = F.col("_m").rlike(PUBLIC_MARK)
    status = marks.select("record_id", F.when(public, "ok").when(F.col("_m").rlike(LOGIN_MARK), "login").otherwise("unknown").alias("status"))
    link = F.col("l.href")
    target = resolve_url(link, F.col("url"))
    root = r"^([^:]+://[^/?#]*).*$"
    same = F.regexp_replace(target, root, "$1") == F.regexp_replace("url", root, "$1")
    path = F.regexp_replace(target, r"^[^:]+://[^/?#]*", "")
    name = F.trim(F.regexp_replace(F.col("l.text"), r"(?i)^Herunterladen\s*", ""))
    name = F.trim(F.regexp_replace(name, r"(?i)\s*\((?:pdf|docx?|zip)[^)]*\)\s*$", ""))
    name = F.coalesce(F.nullif(name, F.lit("")), F.nullif(F.col("l.title"), F.lit("")), F.lit("Planungsdokument"))
    each = (marks.filter(public).select("record_id", "url", F.posexplode(anchors("html")).alias("pos", "l"))
            .select("record_id", "pos", target.alias("id"), name.alias("name"), F.when(F.contains(F.lower("l.text"), F.lit("pdf")), "application/pdf").otherwise("").alias("mime"),
                    (same & path.rlike(r"^/file/[^/?#]+/[^/?#]+$")).alias("ok")).filter("ok"))
    best = first_per_key(each, ["record_id", "id"], [(F.col("name") == "Planungsdokument").asc(), F.col("pos").desc()])
    docs = best.select("id", "record_id", F.lit("").alias("meeting_id"), "name", F.lit("").alias("file_name"), "mime", F.lit("").alias("date"),
                       F.col("id").alias("url"), F.col("id").alias("download_url"), F.lit("plandokument").alias("role"), F.lit("").alias("modified"),
                       F.lit(False).alias("deleted"))
    return docs, status
