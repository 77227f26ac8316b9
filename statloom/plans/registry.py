"""Registry of named queries: a DataFrame builder, its output columns and the checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.sources.tables import Tables

_SPARK_TYPES = {"L": "bigint", "I": "int", "S": "string", "D": "double", "E": "double", "B": "boolean"}
_SQL_TYPES = {"L": "BIGINT", "I": "INTEGER", "S": "VARCHAR", "D": "DOUBLE", "E": "DOUBLE", "B": "BOOLEAN"}
_DIGITS = {"D": 6, "E": 6}
# Running means often end exactly half-way at the seventh decimal. They are rounded as decimals of nine digits, so that
# the last bit of a double doesn't decide in either engine.
_DECIMAL = "decimal(28,9)"


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    columns: tuple[tuple[str, str], ...]
    sql: str | None

    def frame(self, spark, folder: str) -> DataFrame:
        df = self.build(Tables(spark, folder, spread=True))
        return df.select(*[_typed(name, kind) for name, kind in self.columns])

    def checking_sql(self) -> str | None:
        if self.sql is None:
            return None
        items = ", ".join(_typed_sql(name, kind) for name, kind in self.columns)
        return f"SELECT {items} FROM (\n{self.sql.strip()}\n) AS checked"


def _typed(name: str, kind: str):
    c = F.col(name).cast(_SPARK_TYPES[kind])
    if kind == "E":
        return F.round(c.cast(_DECIMAL), _DIGITS[kind]).cast("double").alias(name)
    return (F.round(c, _DIGITS[kind]) if kind in _DIGITS else c).alias(name)


def _typed_sql(name: str, kind: str) -> str:
    c = f'CAST("{name}" AS {_SQL_TYPES[kind]})'
    if kind == "E":
        return f'CAST(round(CAST({c} AS {_DECIMAL}), {_DIGITS[kind]}) AS DOUBLE) AS "{name}"'
    return f'{f"round({c}, {_DIGITS[kind]})" if kind in _DIGITS else c} AS "{name}"'


QUERIES: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register a builder. ``columns`` lists ``name:type`` with L long, I int, S string, D double
    (compared at six decimals), E double that often ends half-way (as a decimal) and B boolean."""
    spec = tuple(tuple(item.split(":")) for item in columns.split())

    def register(build):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, build, spec, sql)
        return build

    return register
