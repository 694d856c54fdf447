"""Column and dataset profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from assay.functions.columns import as_time, batched, clean_input, is_datetime, is_numeric, varies
from assay.operators.quantiles import column_quantiles
from assay.settings import DEFAULTS, Settings

# Names that hint at a time or at a prediction target, and caps.
TIME_TOKENS = ("date", "time", "day", "month", "year")
TARGET_KEYWORDS = (
    "churn", "target", "label", "class", "outcome", "revenue", "sales", "price", "profit",
    "amount", "score", "rating", "conversion", "default", "fraud", "survived", "response", "y",
)
PARSED_SHARE = 0.7
MAX_CATEGORIES = 50
TOP_VALUES = 10
HIGH_NULL_SHARE = 0.2
COLUMNS_PER_PASS = 40

PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("null_count", T.LongType()),
        T.StructField("null_pct", T.DoubleType()),
        T.StructField("distinct_count", T.LongType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("median", T.DoubleType()),
        T.StructField("std", T.DoubleType()),
        T.StructField("skew", T.DoubleType()),
        T.StructField("q1", T.DoubleType()),
        T.StructField("q3", T.DoubleType()),
        T.StructField("outlier_count", T.LongType()),
        T.StructField("min_date", T.StringType()),
        T.StructField("max_date", T.StringType()),
        T.StructField(
            "top_values",
            T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("n", T.LongType())])),
        ),
    ]
)


def sample_skew(c: Column) -> Column:
    """Bias-corrected skewness; 0 for two values or fewer and for constants."""
    n = F.count(c)
    g1 = F.when(varies(c), F.skewness(c)).otherwise(0.0)
    return F.when(n > 2, F.try_divide(g1 * F.sqrt(n * (n - 1.0)), n - F.lit(2.0))).otherwise(0.0)


def time_readings(df: DataFrame) -> dict[str, bool]:
    """Text columns whose name hints at a time and whose values mostly parse,
    each with whether the day comes before the month: one order for the whole
    column, the one that reads more of its values (month first of equals)."""
    hinted = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and any(t in f.name.lower() for t in TIME_TOKENS)
    ]
    if not hinted:
        return {}
    read = [
        F.avg(as_time(df, c, day_first).isNotNull().cast("int")).alias(f"s{i}{int(day_first)}")
        for i, c in enumerate(hinted) for day_first in (False, True)
    ]
    shares = df.agg(*read).first()
    out = {}
    for i, c in enumerate(hinted):
        month, day = shares[f"s{i}0"] or 0.0, shares[f"s{i}1"] or 0.0
        if max(month, day) > PARSED_SHARE:
            out[c] = day > month
    return out


def date_like_columns(df: DataFrame) -> list[str]:
    return list(time_readings(df))


def coerce_datetimes(df: DataFrame) -> DataFrame:
    """Replace date-like text columns by timestamps; what does not parse is null."""
    for c, day_first in time_readings(df).items():
        df = df.withColumn(c, as_time(df, c, day_first))
    return df


def category_cap(n_rows: int) -> int:
    return min(MAX_CATEGORIES, max(2, n_rows // 2))


def classify(dt: T.DataType, distinct: int, n_rows: int) -> str:
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if is_datetime(dt):
        return "datetime"
    if is_numeric(dt):
        return "numeric"
    return "categorical" if distinct <= category_cap(n_rows) else "text"


def _moments(df: DataFrame, fields: list[tuple[int, T.StructField]]) -> dict:
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in fields:
        c = F.col(f"`{f.name}`")
        aggs.append(F.count(c).alias(f"f{i}"))
        if is_numeric(f.dataType):
            x = c.cast("double")
            aggs += [
                F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.avg(x).alias(f"m{i}"),
                F.stddev_samp(x).alias(f"s{i}"), sample_skew(x).alias(f"g{i}"),
            ]
        elif is_datetime(f.dataType):
            aggs += [F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}")]
    return df.agg(*aggs).first().asDict()


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(position, name, distinct_count), nulls left out, exact.

    One branch per column: each reads its column only and shuffles that
    column's distinct values. Many distinct counts in one aggregate would
    instead copy every row once per column.
    """
    parts = []
    for i, c in enumerate(columns):
        one = df.agg(F.count_distinct(F.col(f"`{c}`")).alias("distinct_count"))
        parts.append(one.select(F.lit(i).alias("position"), F.lit(c).alias("name"), "distinct_count"))
    return reduce(DataFrame.unionByName, parts)


def outlier_counts(df: DataFrame, fences: dict[str, tuple[float, float]]) -> dict[str, int]:
    """Values strictly outside 1.5 IQR of the given quartiles; no spread, no outlier."""
    wanted = {c: q for c, q in fences.items() if q[0] is not None and q[1] > q[0]}
    found = dict.fromkeys(fences, 0)
    for part in batched(list(wanted), COLUMNS_PER_PASS):
        aggs = []
        for i, c in enumerate(part):
            q1, q3 = wanted[c]
            x, reach = F.col(f"`{c}`").cast("double"), 1.5 * (q3 - q1)
            aggs.append(F.count_if((x < q1 - reach) | (x > q3 + reach)).alias(f"o{i}"))
        row = df.agg(*aggs).first()
        found.update({c: int(row[i]) for i, c in enumerate(part)})
    return found


def top_values(df: DataFrame, columns: list[str], k: int = TOP_VALUES) -> DataFrame:
    """The k most frequent non-null values per column: (column, rank, value, n).

    Meant for categorical columns, whose number of values is capped.
    """
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    counts = (
        text.unpivot([], columns, "column", "value")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("column", "rank", "value", "n")
    )


def column_profile(df: DataFrame, run_id: str = "run", settings: Settings = DEFAULTS) -> DataFrame:
    """One row per column. Only aggregates of the table reach the driver."""
    spark = df.sparkSession
    df = coerce_datetimes(clean_input(df))
    fields = list(enumerate(df.schema.fields))
    stats: dict = {"n": 0}
    for part in batched(fields, COLUMNS_PER_PASS):
        stats.update(_moments(df, part))
    n = stats["n"]
    distinct: dict[str, int] = {}
    for part in batched(df.columns, COLUMNS_PER_PASS):
        distinct.update({r["name"]: r["distinct_count"] for r in distinct_counts(df, part).collect()})
    roles = {f.name: classify(f.dataType, distinct[f.name], n) for _, f in fields}
    numeric = [f.name for i, f in fields if roles[f.name] == "numeric" and stats[f"f{i}"] > 0]
    groups = [f.name for _, f in fields if roles[f.name] in ("categorical", "boolean")]

    quart = {
        r["column"]: (r["q0"], r["q1"], r["q2"])
        for r in column_quantiles(df, numeric, [0.25, 0.5, 0.75], settings, distinct).collect()
    }
    outliers = outlier_counts(df, {c: (q[0], q[2]) for c, q in quart.items()})
    tops: dict[str, list] = {c: [] for c in groups}
    if groups:
        for r in top_values(df, groups).orderBy("column", "rank").collect():
            tops[r["column"]].append((r["value"], r["n"]))

    rows = []
    for i, f in fields:
        c, role = f.name, roles[f.name]
        nulls = n - stats[f"f{i}"]
        row = dict.fromkeys(PROFILE_SCHEMA.names)
        row.update(
            run_id=run_id, position=i, name=c, role=role, n_rows=n, null_count=nulls,
            null_pct=round(nulls / n, 4) if n else 0.0, distinct_count=distinct[c],
        )
        if c in quart:
            q1, median, q3 = quart[c]
            row.update(
                min=stats[f"lo{i}"], max=stats[f"hi{i}"], mean=stats[f"m{i}"], median=median,
                std=stats[f"s{i}"] or 0.0 if stats[f"lo{i}"] < stats[f"hi{i}"] else 0.0, skew=stats[f"g{i}"], q1=q1, q3=q3, outlier_count=outliers[c],
            )
        elif role == "datetime":
            row.update(min_date=stats[f"lo{i}"], max_date=stats[f"hi{i}"])
        elif c in tops:
            row.update(top_values=tops[c])
        rows.append(tuple(row[k] for k in PROFILE_SCHEMA.names))
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


def is_target_name(name: Column, mode: str = "token") -> Column:
    """``substring`` takes any name containing a keyword, ``token`` whole words."""
    words = F.array(*[F.lit(k) for k in TARGET_KEYWORDS])
    low = F.lower(name)
    if mode == "substring":
        return F.exists(words, lambda k: F.contains(low, k))
    return F.arrays_overlap(F.split(low, r"[^\p{L}\p{N}]+"), words)


def names_in_order(cond: Column) -> Column:
    picked = F.array_sort(F.collect_list(F.when(cond, F.struct("position", "name"))))
    return F.transform(picked, lambda s: s["name"])


def target_columns(profile: DataFrame, mode: str = "token") -> DataFrame:
    return profile.where(is_target_name(F.col("name"), mode)).select("run_id", "position", "name")


def dataset_profile(profile: DataFrame, mode: str = "token") -> DataFrame:
    """One row per run; column names are listed in table order."""
    role = F.col("role")
    return profile.groupBy("run_id").agg(
        F.max("n_rows").alias("rows"),
        F.count(F.lit(1)).alias("cols"),
        (F.count_if(role == "datetime") > 0).alias("has_datetime"),
        names_in_order(role == "datetime").alias("datetime_columns"),
        names_in_order(role.isin("categorical", "boolean")).alias("categorical_columns"),
        names_in_order(role == "numeric").alias("numeric_columns"),
        names_in_order(F.col("null_pct") > HIGH_NULL_SHARE).alias("high_null_columns"),
        names_in_order(is_target_name(F.col("name"), mode)).alias("potential_target_columns"),
    )


def slim_profile(profile: DataFrame) -> DataFrame:
    return profile.select("run_id", "position", "name", "role", "null_pct", "distinct_count")


def role_counts(profile: DataFrame) -> DataFrame:
    return profile.groupBy("run_id", "role").agg(F.count(F.lit(1)).alias("n"))


def missing_ranking(profile: DataFrame) -> DataFrame:
    share = F.try_divide(F.col("null_count"), F.col("n_rows")) * 100
    return (
        profile.where(F.col("null_count") > 0)
        .select("run_id", "name", share.alias("pct_missing"), "position")
        .orderBy("run_id", F.desc("pct_missing"), "position")
        .drop("position")
    )
