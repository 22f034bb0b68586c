"""German text normalisation and word forms as column expressions."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Umlauts are spelled out before accents are removed.
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("Ä", "ae"), ("Ö", "oe"), ("Ü", "ue"))
# Endings a word may lose, tested in this order; the rest keeps five letters.
ENDINGS = ("chen", "lein", "ern", "em", "er", "es", "en", "e", "s", "n")
STEM_MIN = 5
WHITESPACE = r"[\x1c-\x1f\p{IsWhite_Space}]+"
# Every character with a long form lies here.
RARE = r"[\x{bc}-\x{be}\x{100}-\x{10ffff}]"
WORD = r"[\p{L}\p{N}_]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body) -> Column:
    """``body`` of a value that it uses several times and that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


@lru_cache(maxsize=1)
def _compatibility_tables() -> tuple[str, str, str, dict[str, str]]:
    """Tables from the Unicode rule NFKD minus combining marks, for characters that end in 0-9a-z.

    Returns the characters with a one-letter form, these forms, the combining marks to drop and
    the characters with a longer form. Everything else becomes a blank anyway.
    """
    single, forms, marks, longer = [], [], [], {}
    for code in range(128, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        if unicodedata.combining(ch):
            marks.append(ch)
            continue
        flat = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if flat == ch:
            continue
        low = flat.lower()
        if not re.search("[0-9a-z]", low):
            continue
        if len(low) == 1:
            single.append(ch)
            forms.append(low)
        else:
            longer[ch] = re.sub("[^0-9a-z]", " ", low)
    return "".join(single), "".join(forms), "".join(marks), longer


def _char_class(chars) -> str:
    """Regex class with ranges for a set of characters."""
    codes = sorted(ord(c) for c in chars)
    parts, start, prev = [], codes[0], codes[0]
    for code in codes[1:] + [None]:
        if code is not None and code == prev + 1:
            prev = code
            continue
        parts.append(f"\\x{{{start:x}}}" if start == prev else f"\\x{{{start:x}}}-\\x{{{prev:x}}}")
        start = prev = code
    return "[" + "".join(parts) + "]"


def _is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def fold_accents(col) -> Column:
    """Compatibility decomposition without combining marks.

    Cheap tests keep the tables away from texts that do not need them: plain ASCII rows pass as
    they are, and only rows with rarer characters are looked through for long forms.
    """
    c = _c(col)
    single, forms, marks, longer = _compatibility_tables()
    table = F.from_json(F.lit(json.dumps(longer)), "map<string,string>")  # folded to a constant by the planner
    simple = F.translate(c, single + marks, forms)
    expanded = F.array_join(
        F.transform(F.split(simple, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")
    rare = c.rlike(RARE) & c.rlike(_char_class(longer))
    return F.when(_is_ascii(c), c).when(rare, expanded).otherwise(simple)


def spell_umlauts(col) -> Column:
    c = _c(col)
    for old, new in UMLAUTS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def norm(col) -> Column:
    """Comparison form: umlauts spelled out, accents removed, lower case, single blanks; null gives ''."""
    c = F.coalesce(_c(col).cast("string"), F.lit(""))
    return F.trim(F.regexp_replace(F.lower(fold_accents(spell_umlauts(c))), "[^0-9a-z]+", " "))


def tokens(normed) -> Column:
    """Words of an already normalised text; the empty text has none."""
    c = _c(normed)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def street_key_of_norm(normed) -> Column:
    """Spell out the street abbreviation in a normalised text."""
    return F.regexp_replace(_c(normed), r"\b([0-9a-z]{2,}|)str\b", "$1strasse")


def street_key(col) -> Column:
    """Comparison form of street names: ``…str`` and ``str`` become ``…strasse``."""
    return street_key_of_norm(norm(col))


def stem(col) -> Column:
    """Remove the first fitting ending if at least five letters remain."""
    c = _c(col)
    out = None
    for ending in ENDINGS:
        cut = F.substring(c, F.lit(1), F.length(c) - len(ending))
        hit = F.endswith(c, F.lit(ending)) & (F.length(c) >= len(ending) + STEM_MIN)
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(c)


def _short_street(c: Column) -> Column:
    full = "strasse"
    return F.when(F.endswith(c, F.lit(full)) & (F.length(c) > len(full)),
                  F.concat(F.substring(c, F.lit(1), F.length(c) - len(full)), F.lit("str")))


def variants_of_norm(normed) -> Column:
    """Search forms of a normalised word: itself, its stem, the abbreviated street forms."""
    n = _c(normed)
    s = stem(n)
    forms = F.array(n, s, _short_street(n), _short_street(s))
    return F.array_distinct(F.filter(forms, lambda v: v.isNotNull() & (v != "")))


def term_variants(col) -> Column:
    """Search forms of a raw word; a word without letters or digits has none."""
    return variants_of_norm(norm(col))


def short_id(col) -> Column:
    """Last path part of an identifier."""
    return F.element_at(F.split(F.rtrim(_c(col), F.lit("/")), "/"), -1)


def collapse_ws(col) -> Column:
    return F.trim(F.regexp_replace(_c(col), WHITESPACE, " "))


def truncate_text(col, limit: int = 600) -> Column:
    """One line of at most ``limit`` characters; a cut text ends in an ellipsis."""
    c = collapse_ws(col)
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit - 1)), F.lit("…"))).otherwise(c)


def strip_city_hyphen(col, spellings=("Köln", "Koeln", "koeln"), shown: str | None = None) -> Column:
    """``Köln-Niehl`` becomes ``Köln Niehl`` before places are matched."""
    choice = "|".join(re.escape(s) for s in spellings)
    return F.regexp_replace(F.coalesce(_c(col), F.lit("")), rf"(?<!{WORD[:-1]})(?:{choice})\s*-\s*", f"{shown or spellings[0]} ")


def raw_words(col) -> Column:
    """Words in their written form."""
    return F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def search_text(*cols) -> Column:
    """Stored comparison text of a record: the non-empty parts, normalised."""
    return norm(F.concat_ws(" ", *[F.nullif(F.coalesce(_c(c), F.lit("")), F.lit("")) for c in cols]))


def blank(col) -> Column:
    """Missing becomes the empty string, the stored form of 'no value'."""
    return F.coalesce(_c(col).cast("string"), F.lit(""))
