"""Registry of queries: a name, a function of the views, and DuckDB SQL for the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stockweave.sources.views import duckdb_sql, frame

View = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers f(view), where view(name) is a table or inventory view."""

    def add(f: Callable[[View], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda view: frame(spark, sf_dir, view))

        run.__name__ = name
        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = duckdb_sql(sql)
        return f

    return add


# ---- pieces of DuckDB SQL that several queries share ----


def sql_trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def sql_canonical(x: str) -> str:
    collapsed = rf"nullif(regexp_replace({sql_trim(x)}, '[_\-\s]+', ' ', 'g'), '')"
    return f"lower(replace(replace({collapsed}, 'I', 'ı'), 'İ', 'i'))"


def sql_lower(x: str) -> str:
    return f"lower(replace(replace({x}, 'I', 'ı'), 'İ', 'i'))"


def sql_semantic(x: str) -> str:
    """Letters and digits in lower case; the SQL engine has no compatibility forms, so x must be without such characters."""
    return rf"regexp_replace({sql_lower(x)}, '[^\pL\pN]', '', 'g')"


def sql_fold(x: str) -> str:
    return f"replace(lower(strip_accents({x})), 'ı', 'i')"


def sql_alignment(x: str) -> str:
    named = rf"regexp_replace({sql_fold(f'nullif({sql_trim(x)}, {chr(39)}{chr(39)})')}, '^(urun|malzeme|product|item)(\s+adi)?\s*:\s*', '')"
    return rf"regexp_replace(trim(regexp_replace({named}, '[^\pL\pN]+', ' ', 'g')), '\s+', ' ', 'g')"


def sql_dash(x: str) -> str:
    return f"CASE WHEN length(trim({x})) > 0 THEN {x} ELSE '—' END"


def sql_time(x: str) -> str:
    return f"coalesce(strftime({x}, '%d.%m.%Y %H:%M'), '—')"
