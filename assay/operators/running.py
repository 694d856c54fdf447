"""Running totals over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assay.functions.lineage import materialise


def running_totals(
    df: DataFrame, order: list[str], sums: dict[str, Column], groups: list[str] | None = None
) -> DataFrame:
    """Add one inclusive running sum per entry of ``sums``.

    Rows are range-partitioned on (groups, order), so a hot group spreads over
    many tasks as long as ``order`` tells its rows apart. Each partition sums
    its own rows; one small table carries the totals that lie before it. The placed rows are written out first because
    range bounds are sampled anew on every execution.
    """
    groups = groups or []
    placed = materialise(
        df.select("*", *[c.cast("double" if n.startswith("sum_") else "long").alias(f"_{n}") for n, c in sums.items()])
        .repartitionByRange(*groups, *order)
        .withColumn("_part", F.spark_partition_id())
    )
    earlier = Window.partitionBy(*groups, F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = placed.groupBy(*groups, "_part").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums])
    # Only the group a partition starts with can have rows before it, so at most
    # one row per partition is left to broadcast, whatever the number of groups.
    offsets = per_part.select(
        *[F.col(g).alias(f"_r_{g}") for g in groups],
        F.col("_part").alias("_r_part"),
        F.count(F.lit(1)).over(earlier).alias("_earlier"),
        *[F.sum(f"_{n}").over(earlier).alias(f"_before_{n}") for n in sums],
    ).where(F.col("_earlier") > 0)
    on = F.col("_part") == F.col("_r_part")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_r_{g}"))
    within = (
        Window.partitionBy(*groups, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return placed.join(F.broadcast(offsets), on, "left").select(
        *df.columns,
        *[(F.sum(f"_{n}").over(within) + F.coalesce(f"_before_{n}", F.lit(0))).alias(n) for n in sums],
    )
