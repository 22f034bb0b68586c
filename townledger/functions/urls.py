"""Addresses as column expressions: resolve a link against its page and keep it in scope."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, blank, let

SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), SCHEME, 1))


def host(url) -> Column:
    return F.regexp_extract(_c(url), HOST, 1)


def path(url) -> Column:
    return F.regexp_extract(_c(url), PATH, 1)


def query(url) -> Column:
    return F.regexp_extract(_c(url), r"^[^?#]*\?([^#]*)", 1)


def _remove_dots(p: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    def joined(segments: Column) -> Column:
        kept = F.aggregate(
            segments, F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
        tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
        return let(F.concat(F.lit("/"), F.array_join(kept, "/")), lambda j: F.when(j == "/", j).otherwise(F.concat(j, tail)))

    plain = lambda p: F.when(p.rlike(r"(^|/)\.\.?(/|$)"), let(F.split(F.substring(p, F.lit(2), F.length(p)), "/"), joined)).otherwise(p)
    return let(p, plain)


def resolve_url(link, base) -> Column:
    """Absolute form of a link found on the page ``base``."""
    b = blank(base)
    root = F.concat(scheme(b), F.lit("://"), host(b))
    bare = F.regexp_replace(b, "#.*$", "")
    no_query = F.regexp_replace(bare, r"\?.*$", "")
    folder = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path(b), "[^/]*$", ""), "^/+", ""))

    def resolved(l: Column) -> Column:
        link_path = F.regexp_extract(l, r"^([^?#]*)", 1)
        link_rest = F.regexp_extract(l, r"^[^?#]*(.*)$", 1)
        return (F.when(l == "", b)
                .when(l.rlike(SCHEME), l)
                .when(F.startswith(l, F.lit("//")), F.concat(scheme(b), F.lit(":"), l))
                .when(F.startswith(l, F.lit("#")), F.concat(bare, l))
                .when(F.startswith(l, F.lit("?")), F.concat(no_query, l))
                .when(F.startswith(l, F.lit("/")), F.concat(root, _remove_dots(link_path), link_rest))
                .otherwise(F.concat(root, _remove_dots(F.concat(folder, link_path)), link_rest)))

    return let(F.trim(blank(link)), resolved)


def link_scope(link, base, prefix: str | None = None) -> Column:
    """The resolved link without its fragment if it is https, on the page's host and under the prefix."""
    def scoped(target: Column) -> Column:
        ok = (scheme(target) == "https") & (host(target) == host(base)) & (path(target) != "")
        if prefix:
            ok = ok & F.startswith(path(target), F.lit(prefix))
        return F.when(ok, F.regexp_replace(target, "#.*$", "")).otherwise("")

    return let(resolve_url(link, base), scoped)


def fill_template(template, identifier) -> Column:
    """``{id}`` of an address template replaced by a short identifier."""
    return F.replace(_c(template), F.lit("{id}"), _c(identifier))
