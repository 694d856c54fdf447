"""Column-name clean-up."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F, types as T


def clean_name(name: object) -> str:
    """Lower case; every run of other characters becomes one underscore."""
    words = re.findall(r"[^\W_]+", str(name).lower())
    return "_".join(words) or "column"


def unique_names(names: list[str]) -> list[str]:
    """Clean names; repeats count up in column order, skipping taken names."""
    cleaned = [clean_name(n) for n in names]
    taken: set[str] = set()
    repeats: dict[str, int] = {}
    out = []
    for base in cleaned:
        name = base
        while name in taken:
            repeats[base] = repeats.get(base, 0) + 1
            name = f"{base}_{repeats[base]}"
        taken.add(name)
        out.append(name)
    return out


def normalise_columns(df: DataFrame) -> DataFrame:
    """Rename by position, so duplicate raw names are told apart."""
    return df.toDF(*unique_names(df.columns))


def _public_type(dt: T.DataType) -> T.DataType:
    if isinstance(dt, T.StructType):
        return T.StructType(
            [T.StructField(f.name, _public_type(f.dataType), f.nullable) for f in dt.fields if not f.name.startswith("_")]
        )
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(_public_type(dt.elementType), dt.containsNull)
    return dt


def _public(c, dt: T.DataType):
    if isinstance(dt, T.StructType):
        kept = [f for f in dt.fields if not f.name.startswith("_")]
        inner = F.struct(*[_public(c[f.name], f.dataType).alias(f.name) for f in kept])
        return F.when(c.isNotNull(), inner)
    if isinstance(dt, T.ArrayType) and _public_type(dt) != dt:
        return F.transform(c, lambda x: _public(x, dt.elementType))
    if isinstance(dt, T.MapType) and isinstance(dt.keyType, T.StringType):
        kept = F.map_filter(c, lambda k, v: ~F.startswith(k, F.lit("_")))
        if _public_type(dt.valueType) == dt.valueType:
            return kept
        return F.transform_values(kept, lambda k, v: _public(v, dt.valueType))
    return c


def strip_private(df: DataFrame) -> DataFrame:
    """Drop columns, struct fields and map keys that start with an underscore."""
    return df.select(
        *[_public(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if not f.name.startswith("_")]
    )
