"""What the catalogues share: registered queries, their SQL, and small tables for both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lit(x) -> str:
    return "'" + str(x).replace("'", "''") + "'"


def fixture(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(names: str, rows: list[tuple]) -> str:
    one = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "[" + ",".join(map(one, x)) + "]" if isinstance(x, list) else lit(x)
    return f"(VALUES {','.join('(' + ','.join(map(one, r)) + ')' for r in rows)}) AS t({names})"


def bag_sql(x: str) -> str:
    """SQL of the characters and pairs of characters of a text."""
    return f"list_concat(list_transform(range(1, length({x})+1), lambda i: substr({x}, i::INT, 1)), list_transform(range(1, length({x})), lambda i: substr({x}, i::INT, 2)))"


def cosine_sql(a: str, b: str) -> str:
    """SQL of the similarity of two bags a and b."""
    count = lambda of: f"len(list_filter({of}, lambda y: y = g))::DOUBLE"
    norm = lambda of: f"sqrt(list_sum(list_transform(list_distinct({of}), lambda g: {count(of)} * {count(of)})))"
    return f"list_sum(list_transform(list_distinct({a}), lambda g: {count(a)} * {count(b)})) / ({norm(a)} * {norm(b)})"


def similarity_sql(a: str, b: str, most: int = 500) -> str:
    """SQL of the similarity of two texts by their first characters in lower case."""
    a, b = (f"substr(lower({x}),1,{most})" for x in (a, b))
    return f"CASE WHEN {a}='' OR {b}='' THEN 0.0 WHEN {a}={b} THEN 1.0 ELSE {cosine_sql(bag_sql(a), bag_sql(b))} END"
