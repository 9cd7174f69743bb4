"""All registered queries and their SQL, by operator id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that it is held against."""

    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Fixture:
    """A table of a query, the same in Spark and in SQL: made from a given table by expressions, with literal rows for tests.

    ``over`` names the given table and an expression for each column, in words that Spark and the SQL share but for those of
    ``DIALECT``. Where no folder is given, Spark and ``literal`` have the literal rows.
    """

    def __init__(self, name: str, schema: str, rows: list[tuple]):
        self.name, self.schema, self.rows = name, schema, rows
        self.source: tuple[str, dict[str, str], str] | None = None
        FIXTURES.append(self)

    def over(self, table_name: str, columns: dict[str, str], where: str = "true") -> Fixture:
        self.source = table_name, columns, where
        return self

    def df(self, spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
        if sf_dir is None or self.source is None:
            return spark.createDataFrame(self.rows, self.schema)
        name, columns, where = self.source
        kinds = dict(c.strip().rsplit(" ", 1) for c in _columns(self.schema))
        return table(spark, sf_dir, name).where(where).select(*(F.expr(columns[c]).cast(kind).alias(c) for c, kind in kinds.items()))

    def cte(self) -> str:
        """``name AS (SELECT ...)`` for a WITH clause."""
        if self.source is None:
            return self.literal()
        name, columns, where = self.source
        kinds = [c.strip().rsplit(" ", 1) for c in _columns(self.schema)]
        return f"{self.name} AS (SELECT {', '.join(f'CAST({_dialect(columns[c])} AS {TYPES[kind]}) AS {c}' for c, kind in kinds)} FROM {name} WHERE {_dialect(where)})"

    def literal(self) -> str:
        """``name(columns) AS (VALUES ...)``: the literal rows."""
        kinds = [c.strip().rsplit(" ", 1) for c in _columns(self.schema)]
        rows = ", ".join("(" + ", ".join(f"CAST({_literal(v)} AS {TYPES[k[1]]})" for v, k in zip(r, kinds)) + ")" for r in self.rows)
        return f"{self.name}({', '.join(k[0] for k in kinds)}) AS (VALUES {rows})"


FIXTURES: list[Fixture] = []
TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]", "array<int>": "INTEGER[]"}
#: Words of Spark's SQL and of the SQL that queries are held against (fixed values).
DIALECT = {"array(": "list_value(", " div ": " // "}


def _dialect(expression: str) -> str:
    for ours, theirs in DIALECT.items():
        expression = expression.replace(ours, theirs)
    return expression


def _columns(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_literal, v)) + "]"
    return repr(v)


from . import evaluation, governance, more, mutations, retrieval, scalar, sources, stateful, stores, web  # noqa: E402,F401
