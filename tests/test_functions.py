"""Scalar rules against small value tables and plain-Python formulations."""

import html
import random
import re
import unicodedata
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from townledger.functions import dates, rules, text, urls
from townledger.functions.html import anchors, html_to_text, unescape
from townledger.functions.registry import register_functions


def column(spark, values, expr, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in df.select("i", expr.alias("o")).orderBy("i").select("o").collect()]


def plain_norm(s):
    if not s:
        return ""
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("Ä", "ae"), ("Ö", "oe"), ("Ü", "ue")):
        s = s.replace(a, b)
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
    return " ".join(re.sub("[^0-9a-z]+", " ", s).split())


def test_norm_matches_unicode_rule(spark):
    values = [None, "", "Bocklemünd/Mengenich", "Köln-Ehrenfeld", "Straße", "Äpfel ÖL Übung", "Café Çelebi",
              "étage", "½ Meter", "ﬁnal ① №5", "ẞ", "ĳssel", "Ⅳ. Abschnitt", "漢字 abc", "𝒜bc", "K²", "…", "ŉ"]
    values += [f"x{chr(c)}y" for c in range(0xA0, 0x250)] + [f"x{chr(c)}y" for c in range(0x1E00, 0x1F00)]
    values += [f"x{chr(c)}y" for c in range(0x2000, 0x2200)] + [f"x{chr(c)}y" for c in range(0xFF00, 0xFF70)]
    assert column(spark, values, text.norm("v")) == [plain_norm(v) for v in values]


def test_norm_of_every_document(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", text.norm("text").alias("n"))
    assert all(r.n == plain_norm(r.text) for r in df.collect())


def test_street_key(spark):
    got = column(spark, ["Feldgärtenstr.", "Adlerstr", "Rat", "str", "Astr", "Venloer Str. 12"], text.street_key("v"))
    assert got == ["feldgaertenstrasse", "adlerstrasse", "rat", "strasse", "astr", "venloer strasse 12"]


def test_stem_and_variants(spark):
    got = column(spark, ["abendmaerkten", "rat", "bauen", "haeuserchen", "planungen", "kindern"], text.stem("v"))
    assert got == ["abendmaerkt", "rat", "bauen", "haeuser", "planung", "kinder"]
    forms = column(spark, ["Feldgärtenstraße", "strasse", "Märkte", "!!"], text.term_variants("v"))
    assert forms == [["feldgaertenstrasse", "feldgaertenstrass", "feldgaertenstr"], ["strasse", "strass"],
                     ["maerkte", "maerkt"], []]


def test_short_id_and_truncate(spark):
    assert column(spark, ["https://x.de/papers/vo/101373", "a/b/", "x"], text.short_id("v")) == ["101373", "b", "x"]
    long = "wort " * 200
    cut = column(spark, [long, " a \n b "], text.truncate_text("v"))
    assert cut[1] == "a b" and cut[0].endswith("…") and len(cut[0]) <= 600
    assert cut[0] == " ".join(long.split())[:599].rstrip() + "…"


def test_dates(spark):
    assert column(spark, ["2026-10-08T10:00", "2026", None, "20261008xx"], dates.date_de("v")) == ["08.10.2026", "", "", ""]
    assert column(spark, [" 2026-01-02T00:00Z", "am 3.4.2025 um", "nichts", "13.2.20261"], dates.parse_date("v")) == [
        "2026-01-02", "2025-04-03", "", ""]
    shown = column(spark, ["2026-07-01T10:00:00Z", "2026-01-01T10:00", "2026-05-05", "", "2026-07-01T22:30:00+00:00"],
                   dates.moment_de("v"))
    assert shown == ["01.07.2026, 12:00 Uhr", "01.01.2026, 10:00 Uhr", "05.05.2026", "", "02.07.2026, 00:30 Uhr"]
    ends = column(spark, ["2026-05-05", "2026-05-05T10:00:00+02:00", "x"],
                  F.date_format(dates.moment("v", end=True), "yyyy-MM-dd HH:mm:ss"))
    assert ends == ["2026-05-05 21:59:59", "2026-05-05 08:00:00", None]
    assert column(spark, ["90d", "2020-01-01", " ", None], dates.since("v", "2026-04-01")) == [
        "2026-01-01", "2020-01-01", None, None]


@pytest.mark.parametrize("line,short,is_open", [
    ("", "ohne Statusangabe", False), ("Beteiligung ist beendet", "Beteiligung geschlossen", False),
    ("Startet in 3 Tagen", "Beteiligung angekündigt", True), ("vom 1.1. bis 3.1.", "Beteiligung angekündigt", True),
    ("Noch 5 Tage", "Beteiligung läuft", True), ("Unklar", "Unklar", False)])
def test_participation_status(spark, line, short, is_open):
    got = column(spark, [line], rules.participation_status("v"))[0]
    assert (got.short, got.open) == (short, is_open)


def test_result_category_and_steps(spark):
    got = column(spark, ["Übergang zum nächsten TOP", "Mehrheitlich beschlossen", "einstimmig angenommen",
                         "nicht abgelehnt", "zur Kenntnis genommen", "zurückgestellt", "verwiesen", "x", "", None],
                 rules.result_category("v"))
    assert got == ["uebergang", "beschlossen", "beschlossen", "abgelehnt", "kenntnis", "vertagt", "vertagt", "sonstig", None, None]
    steps = column(spark, ["Frühzeitige Beteiligung der Öffentlichkeit zum Plan", "Satzungsbeschluss", "x"], rules.procedure_step("v"))
    assert steps == ["Frühzeitige Beteiligung der Öffentlichkeit", "Satzungsbeschluss", ""]
    assert column(spark, ["ÖFFENTLICHE Bekanntmachung von Bauleitplänen: A"], rules.notice_category("v"))[0] != ""


def test_sentences(spark):
    long = "Erster Satz. " + "Füllsatz ohne Inhalt hier. " * 30 + "Ziel der Planung ist Wohnen. Es sollen 40 Wohneinheiten entstehen. Ende."
    got = column(spark, ["Kurz.", long], rules.extract_sentences("v"))
    assert got[0] == "Kurz."
    assert got[1] == "Erster Satz. Ziel der Planung ist Wohnen. Es sollen 40 Wohneinheiten entstehen."


def test_urls(spark):
    from urllib.parse import urljoin
    base = "https://h.de/a/b/c.html?x=1#f"
    links = ["d.html", "/e/f", "//o.de/x", "?page=2", "#top", "../u", "./v/../w", "https://z.de/", "", "g?x=../y", "../../../k/."]
    df = spark.createDataFrame([(i, l) for i, l in enumerate(links)], "i int, l string")
    got = [r.o for r in df.select("i", urls.resolve_url("l", F.lit(base)).alias("o")).orderBy("i").collect()]
    assert got == [urljoin(base, l) for l in links]
    scoped = [r.o for r in df.select("i", urls.link_scope("l", F.lit(base), "/e/").alias("o")).orderBy("i").collect()]
    assert scoped == ["", "https://h.de/e/f"] + [""] * 9


class _Reader(HTMLParser):
    """Text outside script and style with a blank at every tag, read by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.muted = [], 0

    def handle_starttag(self, tag, attrs):
        self.muted += tag in ("script", "style")
        self.out.append("" if self.muted else " ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.muted = max(self.muted - 1, 0)
        elif not self.muted:
            self.out.append(" ")

    def handle_data(self, data):
        self.out.append("" if self.muted else data)


def read_text(page):
    reader = _Reader()
    reader.feed(page)
    reader.close()
    return " ".join("".join(reader.out).split())


def test_html_equals_a_parser(spark):
    rng = random.Random(1)
    refs = ["&amp;", "&auml;", "&notit;", "&ampx", "&#8364;", "&#x20ac;", "&#128;", "&#0;", "&#xD800;", "&#99999999999999999;", "&#9;", "&;", "&", "&unknown;", "&hellip;", "&lt;b&gt;", "&amp;lt;",
            "&CounterClockwiseContourIntegral;", "&#1;", "&#xFFFF;", "&nbsp;", "&eacute", "&NotEqualTilde;"]
    tags = ['<p class="a>b">', "</p >", "<br/>", "<!-- c <b> & -->", '<script>x<y && "</b>"</script>', "<style type=x>p{}</STYLE>", "<!DOCTYPE html>", "<a href='x\"y'>", "</a>", '<IMG alt=">">',
            " x ", "\u00a0", "&amp;", "text", "<?xml v?>", "<3"]
    texts = ["a " + "".join(rng.choice(refs) + rng.choice(" z") for _ in range(4)) for _ in range(150)]
    pages = ["".join(rng.choice(tags) for _ in range(rng.randint(1, 12))) + " end" for _ in range(200)]
    assert column(spark, texts, unescape("v")) == [html.unescape(t) for t in texts]
    assert column(spark, texts + pages, html_to_text("v")) == [read_text(t) for t in texts + pages]


def test_anchors_of_a_page(spark):
    page = ('<a href="/x?a=1&amp;b=2" title=\'T "q"\'>One <b>two</b>&nbsp;&lt;3</a><!-- <a href="/no">n</a> --><script>"<a href=\\"/s\\">s</a>"</script>'
            '<a class=k href=/y>open <a data-href="z" HREF=\'/z\'>Z</A ><A>bare</A><abbr>a</abbr><a href="/end">never closed')
    got = [tuple(a) for a in column(spark, [page], anchors("v"))[0]]
    assert got == [("/x?a=1&b=2", 'T "q"', "One two <3"), ("/z", "", "Z"), ("", "", "bare")]


def test_html_and_sql_registration(spark):
    page = "<p>A&amp;B</p><script>x<y</script>C<br>D &uuml;"
    assert column(spark, [page, None], html_to_text("v")) == ["A&B C D ü", ""]
    register_functions(spark)
    row = spark.sql("SELECT town_norm('Köln ½ é') a, town_street_key('Adlerstr.') b, town_stem('planungen') c, "
                    "town_html_to_text('<b>x</b>y') d").first()
    assert tuple(row) == ("koeln 1 2 e", "adlerstrasse", "planung", "x y")
