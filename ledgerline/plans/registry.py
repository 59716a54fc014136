"""Query registry: every operator key maps to a Spark callable ``(spark, sf_dir)
-> DataFrame`` and, where SQL can express it, a DuckDB oracle over the same
driver tables.  Doubles are rounded to 4 places on both sides (sums of doubles
depend on evaluation order), and both sides use the same column names."""

from __future__ import annotations

from typing import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DateType, DoubleType, FloatType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CHECK: dict[str, str] = {}   # key -> "sql" | "rows"


def finish(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double/float column (top level) to ``digits`` places and render
    dates as ISO text, so both engines' results hash alike."""
    def conv(f):
        c = "`" + f.name.replace("`", "``") + "`"
        if isinstance(f.dataType, (DoubleType, FloatType)):
            return f"round(CAST({c} AS DOUBLE), {digits}) + 0D AS {c}"      # + 0.0: no -0.0
        if isinstance(f.dataType, DateType):
            return f"date_format({c}, 'yyyy-MM-dd') AS {c}"
        return c
    return df.selectExpr(*[conv(f) for f in df.schema.fields])      # one JVM call for the projection


def rounded_sql(body: str, dbl: Iterable[str] = (), digits: int = 4, dates: Iterable[str] = ()) -> str:
    cols, dcols = list(dbl), list(dates)
    if not cols and not dcols:
        return body
    rep = ", ".join([f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in cols]
                    + [f"strftime(CAST({c} AS DATE), '%Y-%m-%d') AS {c}" for c in dcols])
    return f"SELECT * REPLACE ({rep}) FROM (\n{body}\n) AS _q"


def register(key: str, sql: str | None = None, dbl: Iterable[str] = (), round_result: bool = True,
             dates: Iterable[str] = ("day",), digits: int = 4):
    """Decorator: register a Spark query and (optionally) its oracle SQL."""
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return finish(df, digits) if round_result else df
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = rounded_sql(sql, dbl, digits=digits, dates=dates)
            CHECK[key] = "sql"
        else:
            CHECK[key] = "rows"
        return fn
    return deco


def load_all() -> None:
    """Import every catalog module (each registers its keys on import)."""
    from ledgerline.plans import (catalog_token, catalog_primitives, catalog_report,  # noqa: F401
                                  catalog_abuse, catalog_segment, catalog_forecast, catalog_text)
