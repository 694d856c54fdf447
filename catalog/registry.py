"""Registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over the tables of a folder."""

    def add(fn: Callable[["Tables"], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


class Tables:
    """The parquet tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def sql(self, text: str, **views: DataFrame) -> DataFrame:
        return self.spark.sql(text, **views)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c).cast("double"), digits))
    return df


def longs(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("long"))
    return df


def joined(names: Column | str) -> Column:
    """A list as one text, so that both engines return plain columns."""
    return F.array_join(names, "|")


# Tables with gaps: the given tables hold no nulls, so values are blanked by a rule.
ORDERS_GAPS = """
select o_orderkey, o_custkey, nullif(o_orderstatus, 'P') as o_orderstatus,
       case when o_totalprice <= 400000 then o_totalprice end as o_totalprice,
       o_orderdate, o_orderpriority from {orders}
"""
CUSTOMER_GAPS = """
select c_custkey, c_nationkey, case when c_acctbal <= 9000 then c_acctbal end as c_acctbal,
       nullif(c_mktsegment, 'MACHINERY') as c_mktsegment from {customer}
"""
LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINE_ALL = """
select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, case when l_extendedprice <= 90000 then l_extendedprice end as l_extendedprice,
       nullif(l_discount, 0.0) as l_discount, l_tax from {lineitem}
"""
LINE_GAPS = """
select l_quantity, case when l_extendedprice <= 90000 then l_extendedprice end as l_extendedprice,
       nullif(l_discount, 0.0) as l_discount, l_tax, l_returnflag from {lineitem}
"""


def gaps(t: Tables, text: str) -> DataFrame:
    names = [n for n in ("orders", "customer", "lineitem") if "{" + n + "}" in text]
    return t.spark.sql(text, **{n: getattr(t, n) for n in names})


def plain(text: str) -> str:
    """The same text with bare table names."""
    return text.replace("{", "").replace("}", "")
