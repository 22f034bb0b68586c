"""Registry of checked queries and the SQL pieces they share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from townledger.session import configure, ensure_checkpoint_dir, spread

TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say the same, its formulation."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)


            def table(name: str) -> DataFrame:
                df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
                return spread(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df

            # The name as a glob: a table may be one file or a folder of files.
            table.stream = lambda name: (spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema)
                                         .parquet(f"{sf_dir}/{{{name}.parquet}}"))
            table.scratch = lambda: f"{ensure_checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"
            return fn(table)
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn
    return add


# --- SQL pieces ----------------------------------------------------------------

def s_norm(x: str) -> str:
    t = f"coalesce(cast({x} as varchar), '')"
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("Ä", "ae"), ("Ö", "oe"), ("Ü", "ue")):
        t = f"replace({t}, '{a}', '{b}')"
    return f"trim(regexp_replace(lower(strip_accents({t})), '[^0-9a-z]+', ' ', 'g'))"


def s_street(n: str) -> str:
    """Street form of a normalised text, by words."""
    return (f"list_aggregate(list_transform(string_split({n}, ' '), lambda w: CASE WHEN w = 'str' THEN 'strasse' "
            f"WHEN length(w) >= 5 AND ends_with(w, 'str') THEN w[:length(w)-3] || 'strasse' ELSE w END), 'string_agg', ' ')")


def s_stem(w: str) -> str:
    arms = " ".join(f"WHEN ends_with({w}, '{e}') AND length({w}) - {len(e)} >= 5 THEN left({w}, length({w}) - {len(e)})"
                    for e in ("chen", "lein", "ern", "em", "er", "es", "en", "e", "s", "n"))
    return f"CASE {arms} ELSE {w} END"


def s_short(v: str) -> str:
    return f"CASE WHEN ends_with({v}, 'strasse') AND length({v}) > 7 THEN left({v}, length({v}) - 7) || 'str' END"


def s_variants(n: str) -> str:
    st = s_stem(n)
    return (f"list_filter([{n}, CASE WHEN ({st}) <> {n} THEN {st} END, {s_short(n)}, "
            f"CASE WHEN ({st}) <> {n} THEN {s_short('(' + st + ')')} END], lambda v: v IS NOT NULL)")


def s_tokens(n: str) -> str:
    return f"list_filter(string_split({n}, ' '), lambda w: w <> '')"


def s_date_de(d: str) -> str:
    return f"CASE WHEN length({d}) >= 10 AND substr({d},5,1)='-' THEN substr({d},9,2)||'.'||substr({d},6,2)||'.'||substr({d},1,4) ELSE '' END"


def s_result(n: str) -> str:
    return (f"CASE WHEN {n}='' THEN NULL WHEN contains({n},'uebergang') THEN 'uebergang' WHEN contains({n},'abgelehnt') THEN 'abgelehnt' "
            f"WHEN contains({n},'beschlossen') OR contains({n},'angenommen') THEN 'beschlossen' WHEN contains({n},'kenntnis') THEN 'kenntnis' "
            f"WHEN contains({n},'erledigt') THEN 'erledigt' WHEN contains({n},'zurueckgezogen') THEN 'zurueckgezogen' "
            f"WHEN contains({n},'verwiesen') OR contains({n},'zurueckgestellt') OR contains({n},'vertagt') THEN 'vertagt' ELSE 'sonstig' END")


# Named sub-queries; each may use those listed before its text.
CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTE[name] = (needs, sql)


def with_ctes(*names: str, body: str, recursive: bool = False) -> str:
    order: list[str] = []

    def visit(n):
        for m in CTE[n][0]:
            visit(m)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in order) + "\n" + body
