"""Loading tables from files, queries and databases."""

from __future__ import annotations

import os
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from assay.operators.validate import validate
from assay.sources.naming import normalise_columns

# Delimiters tried, lines looked at.
DELIMITERS = (",", ";", "\t", "|")
SNIFF_LINES = 50
_FORMATS = {".csv": "csv", ".tsv": "csv", ".txt": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json", ".orc": "orc"}


@dataclass
class LoadedTable:
    df: DataFrame
    validation: DataFrame
    metadata: DataFrame


def _outside_quotes(line: str) -> Counter:
    bare = "".join(part for i, part in enumerate(line.split('"')) if i % 2 == 0)
    return Counter(c for c in bare if c in DELIMITERS)


def sniff_delimiter(lines: list[str]) -> str:
    """The delimiter found equally often on most lines; more columns win ties."""
    counts = [_outside_quotes(x) for x in lines if x.strip()]
    best, best_vote = ",", (0, 0)
    for d in DELIMITERS:
        seen = Counter(c[d] for c in counts if c[d])
        if seen:
            per_line, agree = max(seen.items(), key=lambda kv: (kv[1], kv[0]))
            if (agree, per_line) > best_vote:
                best, best_vote = d, (agree, per_line)
    return best


def sniff_encoding(text: DataFrame) -> str:
    """UTF-8 unless some line holds bytes that are not; the probe stops at the first."""
    broken = text.where(~F.is_valid_utf8("value")).take(1)
    return "ISO-8859-1" if broken else "UTF-8"


def load_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with header: encoding and delimiter are found, types inferred, names cleaned.

    ``multi_line`` allows line breaks inside quotes, at the price that a file
    can no longer be split over tasks.
    """
    text = spark.read.text(path)
    lines = [r["value"] for r in text.limit(SNIFF_LINES).collect()]
    if not lines:
        raise ValueError(f"No rows to parse in {path}")
    df = spark.read.csv(
        path, header=True, inferSchema=True, sep=sniff_delimiter(lines), encoding=sniff_encoding(text),
        multiLine=multi_line, escape='"', enforceSchema=False,
    )
    return normalise_columns(df)


def load_sql(spark: SparkSession, query: str) -> DataFrame:
    """Result of a query over the session's tables and views."""
    return normalise_columns(spark.sql(query))


def load_database(
    spark: SparkSession, url: str, query: str, split_column: str | None = None,
    bounds: tuple[int, int] | None = None, partitions: int = 1, **options: str,
) -> DataFrame:
    """Result of a query run by an external database; a split column reads it in parallel."""
    reader = spark.read.format("jdbc").option("url", url)
    for name, value in options.items():
        reader = reader.option(name, value)
    if split_column is None:
        reader = reader.option("query", query)
    else:
        if bounds is None:
            raise ValueError("a split column needs bounds")
        reader = (
            reader.option("dbtable", f"({query}) q").option("partitionColumn", split_column)
            .option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
        )
    return normalise_columns(reader.load())


def file_format(path: str) -> str:
    return _FORMATS.get(os.path.splitext(path.rstrip("/").lower())[1], "csv")


def table_metadata(df: DataFrame, kind: str, filename: str) -> DataFrame:
    return df.agg(
        F.lit(kind).alias("source_kind"), F.lit(filename).alias("filename"), F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("cols"),
    )


def load_any(spark: SparkSession, path: str, filename: str | None = None) -> LoadedTable:
    """Load by extension and describe what was loaded."""
    kind = file_format(filename or path)
    df = load_csv(spark, path) if kind == "csv" else normalise_columns(spark.read.format(kind).load(path))
    return LoadedTable(df, validate(df), table_metadata(df, kind, filename or path))


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """(position, name, n) of the candidate tables, in the given order."""
    out = None
    for i, (name, df) in enumerate(tables.items()):
        one = df.agg(F.lit(i).alias("position"), F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def largest_table(tables: dict[str, DataFrame]) -> DataFrame:
    """The candidate with the most rows; the first one wins ties."""
    return table_sizes(tables).orderBy(F.desc("n"), "position").limit(1)


def load_largest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The largest readable table among the paths; unreadable ones are skipped."""
    tables = {}
    for p in paths:
        try:
            tables[p] = load_any(spark, p).df
        except Exception:
            continue
    if not tables:
        raise ValueError("none of the paths could be read")
    return tables[largest_table(tables).first()["name"]]
