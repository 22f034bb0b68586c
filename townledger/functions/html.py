"""HTML fragments to plain text, as SQL over the whole fragment: tags to blanks, then character references.

The text is cut at every '&' and each piece decodes the one reference it starts with, so nothing is decoded twice.
"""

from __future__ import annotations

from html.entities import html5
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITESPACE, _c

COMMENT = r"(?s)<!--.*?(?:-->|\z)"
SILENT = r"(?is)<(script|style)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\z)"
DECLARATION = r"<(?:[!?]|/[^a-zA-Z])[^>]*>"
# A tag ends at the first '>' outside quotes; with unbalanced quotes at the first of all.
TAG = r"""</?[a-zA-Z][^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>"""
LOOSE_TAG = r"</?[a-zA-Z][^>]*>"
ANCHOR_START = r"(?i)(?=<a[\s>])"
REPLACED = "\ufffd"


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replace(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {sql_string(pattern)}, {sql_string(by)})"


def _character(n: str) -> str:
    """Character of a number as the HTML rules read it: C1 numbers are those of code page 1252, impossible ones are replaced."""
    c1 = ", ".join(sql_string(bytes([i]).decode("cp1252", "replace") if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(i)) for i in range(128, 160))
    silent = f"{n} BETWEEN 1 AND 8 OR {n} = 11 OR {n} BETWEEN 14 AND 31 OR {n} BETWEEN 127 AND 127 OR {n} BETWEEN 64976 AND 65007 OR {n} % 65536 >= 65534"
    return (f"CASE WHEN {n} IS NULL OR {n} = 0 OR {n} > 1114111 OR {n} BETWEEN 55296 AND 57343 THEN {sql_string(REPLACED)} "
            f"WHEN {n} BETWEEN 128 AND 159 THEN element_at(array({c1}), cast({n} - 127 AS int)) WHEN {silent} THEN '' "
            f"ELSE decode(unhex(lpad(hex({n}), 8, '0')), 'UTF-32') END")


# All named references as one text, name and value between marks: a text is cheap to plan with, a map of its size is not. It is cut
# into lists by the checksum of the name once per plan, so that a look-up reads one short list.
NAME, VALUE, LIST, LISTS = "\x01", "\x02", "\x03", 512
_LISTS = [[] for _ in range(LISTS)]
for _k, _v in html5.items():
    _LISTS[crc32(_k.encode()) % LISTS].append(_k + VALUE + _v)
NAMES = LIST.join(NAME + NAME.join(part) + NAME for part in _LISTS)


def _named(name: str) -> str:
    """Value of a named reference, null if there is none of that name."""
    listed = f"element_at(split({sql_string(NAMES)}, {sql_string(LIST)}), cast(crc32({name}) % {LISTS} AS int) + 1)"
    at = f"locate(concat({sql_string(NAME)}, {name}, {sql_string(VALUE)}), b)"
    found = _let("i", at, f"IF(i = 0, NULL, substring_index(substring(b, i + length({name}) + 2), {sql_string(NAME)}, 1))")
    return f"IF({name} = '', NULL, {_let('b', listed, found)})"


def _let(name: str, value: str, body: str) -> str:
    """``value`` worked out once under a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def unescape_sql(x: str) -> str:
    """Text with its character references decoded once."""
    prefix = "^(" + "|".join(sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))) + ")"
    full = r"^([A-Za-z][A-Za-z0-9]*;)"

    def take(pattern):
        return f"regexp_extract(p, {sql_string(pattern)}, 1)"

    def numbered(pattern, base):
        # longer numbers than any character has are impossible ones
        code = f"IF(length({take(pattern)}) > 12, NULL, cast(conv(nullif({take(pattern)}, ''), {base}, 10) AS bigint))"
        return f"concat({_let('n', code, _character('n'))}, {_replace('p', pattern + ';?', '')})"

    decimal, hexadecimal = r"^#([0-9]+)", r"^#[xX]([0-9a-fA-F]+)"
    one = (f"CASE WHEN startswith(p, 'amp;') THEN concat('&', substring(p, 5)) WHEN p RLIKE {sql_string(decimal)} THEN {numbered(decimal, 10)} "
           f"WHEN p RLIKE {sql_string(hexadecimal)} THEN {numbered(hexadecimal, 16)} "
           f"ELSE coalesce(concat({_let('e', take(full), _named('e'))}, {_replace('p', full, '')}), "
           f"concat({_let('e', take(prefix), _named('e'))}, {_replace('p', prefix, '')}), concat('&', p)) END")
    pieces = _let("q", f"split({x}, '&')", f"concat(element_at(q, 1), array_join(transform(slice(q, 2, greatest(size(q) - 1, 0)), p -> {one}), ''))")
    return f"IF(contains({x}, '&'), {pieces}, {x})"


def without_markup_sql(x: str) -> str:
    bare = _replace(_replace(_replace(_replace(_replace(x, COMMENT, ""), SILENT, ""), DECLARATION, ""), TAG, " "), LOOSE_TAG, " ")
    return f"IF(contains({x}, '<'), {bare}, {x})"


def text_sql(x: str) -> str:
    """Plain text of a fragment: a blank for every tag, no comments, scripts or styles, single blanks; null gives ''."""
    bare = _let("h", f"coalesce({x}, '')", without_markup_sql("h"))
    return _let("t", bare, f"trim({_replace(unescape_sql('t'), WHITESPACE, ' ')})")


def _apply(col: Column, sql: str) -> Column:
    """An SQL text over the variable ``v`` applied to a column."""
    return F.get(F.call_function("transform", F.array(col), F.expr(f"v -> {sql}")), 0)


def html_to_text(col) -> Column:
    """Plain text of a fragment; null gives the empty text."""
    return _apply(_c(col).cast("string"), text_sql("v"))


def html_to_text_array(parts) -> Column:
    """The same for a list of fragments; a null list stays null."""
    return F.call_function("transform", _c(parts), F.expr(f"v -> {text_sql('v')}"))


def unescape(col) -> Column:
    return _apply(_c(col), unescape_sql("v"))


def attribute(tag: Column, name: str) -> Column:
    """Value of a start tag's attribute, '' if it has none."""
    found = rf"""(?is)^<[a-z][^\s>/]*(?:"[^"]*+"|'[^']*+'|[^"'>])*?\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return unescape(F.concat(*[F.regexp_extract(tag, found, i) for i in (1, 2, 3)]))


def live_markup(html) -> Column:
    """The markup without comments, scripts and styles."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(_c(html), F.lit("")), COMMENT, ""), SILENT, "")


def anchors(html) -> Column:
    """Anchors of a page in order, as structs of href, title and text; one that is not closed before the next one is left out."""
    pieces = F.filter(F.split(live_markup(html), ANCHOR_START), lambda p: p.rlike(r"(?is)^<a[\s>].*</a\s*>"))

    def read(p: Column) -> Column:
        tag = F.regexp_extract(p, r"""(?is)^(<a(?:"[^"]*+"|'[^']*+'|[^"'>])*+>)""", 1)
        inner = F.regexp_extract(F.substring(p, F.length(tag) + 1, F.length(p)), r"(?is)^(.*?)</a\s*>", 1)
        return F.struct(attribute(tag, "href").alias("href"), attribute(tag, "title").alias("title"), inner.alias("inner"))

    found = F.transform(pieces, read)
    texts = html_to_text_array(F.transform(found, lambda a: a["inner"]))
    return F.zip_with(found, texts, lambda a, t: F.struct(a["href"].alias("href"), a["title"].alias("title"), t.alias("text")))
