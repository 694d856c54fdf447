"""Table sanity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assay.functions.columns import clean_input

# Smallest usable table, missing share that is worth a warning.
MIN_ROWS = 10
MIN_COLS = 2
HIGH_MISSING = 0.5


def missing_shares(df: DataFrame) -> DataFrame:
    """(position, name, n_rows, null_count, null_share) in one pass."""
    df = clean_input(df)
    counted = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(df.columns)])
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), F.col(f"_{i}").alias("filled"))
            for i, c in enumerate(df.columns)
        ]
    )
    return (
        counted.select("_n", F.explode(cells).alias("c"))
        .select(
            "c.position",
            "c.name",
            F.col("_n").alias("n_rows"),
            (F.col("_n") - F.col("c.filled")).alias("null_count"),
        )
        .withColumn("null_share", F.coalesce(F.try_divide("null_count", "n_rows"), F.lit(0.0)))
    )


def empty_columns(df: DataFrame) -> DataFrame:
    return missing_shares(df).where(F.col("null_count") == F.col("n_rows")).select("position", "name")


def high_missing_columns(df: DataFrame) -> DataFrame:
    m = missing_shares(df)
    return m.where(
        (F.col("null_share") > HIGH_MISSING) & (F.col("null_count") < F.col("n_rows"))
    ).select("position", "name", "null_share")


def _fingerprint(df: DataFrame) -> list[Column]:
    """Two independent 64-bit row hashes; the null flags keep shifted nulls apart."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    flags = [F.col(f"`{f.name}`").isNull().cast("int") for f in df.schema.fields if f.nullable]
    return [F.xxhash64(*cols, *flags).alias("_h1"), F.xxhash64(F.lit(1), *flags, *cols).alias("_h2")]


def duplicate_rows(df: DataFrame, compare: str = "fingerprint") -> DataFrame:
    """One row: how many rows repeat another, nulls equal.

    ``fingerprint`` moves 16 bytes per distinct row (128 bits, so a false match
    is out of reach at any real table size); ``columns`` groups by the values
    themselves. Copies collapse before the shuffle either way.
    """
    df = clean_input(df)
    if compare == "fingerprint":
        copies = df.select(*_fingerprint(df)).groupBy("_h1", "_h2").count()
    else:
        copies = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).count()
    return copies.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def shape_errors(rows: Column, cols: int) -> Column:
    """Error texts for a table that is too small."""
    few_rows = F.when(
        rows < MIN_ROWS,
        F.format_string(
            f"The table has %d rows, fewer than the {MIN_ROWS} that an analysis takes.", rows
        ),
    )
    few_cols = F.when(
        F.lit(cols) < MIN_COLS,
        F.lit(f"The table has {cols} column(s), fewer than the {MIN_COLS} that an analysis takes."),
    )
    return F.array_compact(F.array(few_rows, few_cols))


def shape_check(df: DataFrame) -> DataFrame:
    counted = df.agg(F.count(F.lit(1)).alias("row_count"))
    return counted.select(
        "row_count",
        F.lit(len(df.columns)).cast("long").alias("col_count"),
        shape_errors(F.col("row_count"), len(df.columns)).alias("errors"),
    )


def _name_list(names: Column) -> Column:
    quoted = F.transform(names, lambda c: F.concat(F.lit("'"), c, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def validate(df: DataFrame) -> DataFrame:
    """One row {valid, warnings, errors, row_count, col_count}."""
    gaps = missing_shares(df)
    all_null = F.col("null_count") == F.col("n_rows")
    many_null = (F.col("null_share") > HIGH_MISSING) & ~all_null

    def listed(cond: Column) -> Column:
        picked = F.array_sort(F.collect_list(F.when(cond, F.struct("position", "name"))))
        return F.transform(picked, lambda s: s["name"])

    summary = gaps.agg(
        F.max("n_rows").alias("row_count"), listed(all_null).alias("empty"), listed(many_null).alias("sparse")
    )
    # Both sides are single-row aggregates.
    both = summary.withColumn("_one", F.lit(1)).join(
        F.broadcast(duplicate_rows(df).withColumn("_one", F.lit(1))), "_one"
    )
    warnings = F.array_compact(
        F.array(
            F.when(
                F.size("empty") > 0,
                F.concat(F.lit("Columns without any value, which are left out: "), _name_list(F.col("empty"))),
            ),
            F.when(
                F.size("sparse") > 0,
                F.concat(F.lit("Columns with gaps in more than half of the rows: "), _name_list(F.col("sparse"))),
            ),
            F.when(
                F.col("duplicate_rows") > 0,
                F.concat(F.col("duplicate_rows").cast("string"), F.lit(" row(s) repeat an earlier one in full.")),
            ),
        )
    )
    errors = shape_errors(F.col("row_count"), len(df.columns))
    return both.select(
        (F.size(errors) == 0).alias("valid"),
        warnings.alias("warnings"),
        errors.alias("errors"),
        "row_count",
        F.lit(len(df.columns)).cast("long").alias("col_count"),
    )
