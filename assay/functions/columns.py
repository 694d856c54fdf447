"""Column roles and the input clean-up every operator relies on."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

_NESTED = (T.ArrayType, T.MapType, T.StructType)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def clean_input(df: DataFrame) -> DataFrame:
    """NaN becomes null, nested columns become JSON text, binary becomes hex.

    A projection only: nothing is read or moved here.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, _NESTED):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.BinaryType):
            c = F.hex(c)
        elif isinstance(f.dataType, T.VariantType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def varies(c: Column) -> Column:
    """Aggregate: the column takes more than one value.

    The exact test for a constant: merged variances of a constant column can
    come out as a tiny positive number.
    """
    return F.coalesce(F.min(c) < F.max(c), F.lit(False))


def as_number(df: DataFrame, name: str) -> Column:
    """The column as DOUBLE; text that is no number becomes null."""
    dt = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(dt, T.StringType):
        c = c.try_cast("double")
    else:
        c = c.cast("double")
    return F.when(~F.isnan(c), c)


def as_time(df: DataFrame, name: str, day_first: bool = False) -> Column:
    """The column as TIMESTAMP; text that is no time becomes null. Where both
    orders of day and month are possible, ``day_first`` decides.

    A value is parsed with the layouts that its signature (digits as 9, letters
    as a) fits and with no other, so that hardly any attempt fails.
    """
    dt = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if not isinstance(dt, T.StringType):
        return c.cast("timestamp")
    signature = F.translate(c, _FROM, _TO)
    by_layouts: dict[tuple[str, ...], list[str]] = {}
    for known, layouts in _layouts_of(DAY_FIRST if day_first else MONTH_FIRST).items():
        by_layouts.setdefault(layouts, []).append(known)
    parsed = F.lit(None).cast("timestamp")
    for layouts, signatures in by_layouts.items():
        parsed = F.when(signature.isin(signatures), F.coalesce(*[F.try_to_timestamp(c, F.lit(p)) for p in layouts])).otherwise(parsed)
    return F.coalesce(c.try_cast("timestamp"), parsed)


_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FROM, _TO = "0123456789" + _LETTERS, "9" * 10 + "a" * len(_LETTERS)
# Signatures that a pattern letter run can take; month names have 3 to 9 letters.
_FIELDS = {"yyyy": ["9999"], "yy": ["99"], "MMMM": ["a" * n for n in range(3, 10)], "MMM": ["aaa"], "MM": ["99"], "dd": ["99"], "mm": ["99"], "ss": ["99"], "M": ["9", "99"], "d": ["9", "99"], "H": ["9", "99"]}


def _signatures(layout: str) -> list[str]:
    """Every signature that a layout reads, optional parts with and without."""
    if "[" in layout:
        at = layout.index("[")
        return _signatures(layout[:at]) + _signatures(layout[:at] + layout[at + 1 : -1])
    out = [""]
    for part in re.findall(r"([A-Za-z])(\1*)|([^A-Za-z])", layout):
        options = _FIELDS[part[0] + part[1]] if part[0] else [part[2]]
        out = [o + x for o in out for x in options]
    return out


def _layouts_of(layouts: tuple) -> dict[str, tuple[str, ...]]:
    """Signature -> the layouts to try, in their order; None is read by the cast."""
    out: dict[str, tuple[str, ...]] = {}
    for layout in layouts:
        for signature in _signatures(layout) if layout else []:
            out[signature] = (*out.get(signature, ()), layout)
    return out


# Accepted layouts of date-like text; None is the ISO form.
_COMMON = (
    None,
    "yyyy/M/d[ H:mm[:ss]]",
    "yyyy.M.d[ H:mm[:ss]]",
    "yyyyMMdd",
    "d-MMM-yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMM d yyyy",
    "MMMM d, yyyy",
    "MMMM d yyyy",
)
_MONTH = ("M/d/yyyy[ H:mm[:ss]]", "M-d-yyyy[ H:mm[:ss]]", "M.d.yyyy[ H:mm[:ss]]", "M/d/yy")
_DAY = ("d/M/yyyy[ H:mm[:ss]]", "d-M-yyyy[ H:mm[:ss]]", "d.M.yyyy[ H:mm[:ss]]", "d/M/yy")
MONTH_FIRST = _COMMON + _MONTH
DAY_FIRST = _COMMON + _DAY


def batched(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]
