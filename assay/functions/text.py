"""Labels and number formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Label thresholds.
STRENGTH_STEPS = ((0.7, "strong"), (0.4, "moderate"), (0.2, "weak"))
CONFIDENCE_STEPS = (
    (0.8, "High confidence", "#1a9850"),
    (0.5, "Moderate confidence", "#fc8d59"),
)
CONFIDENCE_FLOOR = ("Low confidence — interpret with caution", "#d73027")
NUMBER_STEPS = ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K"))
STRENGTH_ADVERB = {
    "strong": "strongly",
    "moderate": "moderately",
    "weak": "weakly",
    "negligible": "negligibly",
}


def fixed_point(value: Column, decimals: int) -> Column:
    """Fixed decimals, rounded on the exact binary value."""
    pattern = "0." + "0" * decimals if decimals else "0"
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def strength_label(r: Column) -> Column:
    out = F.when(r.isNull(), F.lit(None).cast("string"))
    for bound, label in STRENGTH_STEPS:
        out = out.when(F.abs(r) >= bound, label)
    return out.otherwise("negligible")


def strength_adverb(label: Column) -> Column:
    return F.element_at(
        F.create_map(*[F.lit(x) for kv in STRENGTH_ADVERB.items() for x in kv]), label
    )


def titleize(name: Column) -> Column:
    """Snake case to title case; a letter after any non-letter is capitalised."""
    clean = F.lower(F.trim(F.replace(name, F.lit("_"), F.lit(" "))))
    words = F.split(clean, r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), ""
    )


def human_number(value: Column, decimals: int = 2) -> Column:
    """Compact number text such as 1.23M; text that is no number passes through."""
    num = value.try_cast("double")
    size = F.abs(num)
    sign = F.when(num < 0, "-").otherwise("")
    out = F.when(num.isNull(), F.coalesce(value.cast("string"), F.lit("None"))).when(
        F.isnan(num) | (size == float("inf")), "n/a"
    )
    for bound, suffix in NUMBER_STEPS:
        out = out.when(size >= bound, F.concat(sign, fixed_point(size / bound, decimals), F.lit(suffix)))
    out = out.when(size == F.floor(size), F.concat(sign, F.floor(size).cast("string")))
    return out.otherwise(F.concat(sign, fixed_point(size, decimals)))


def percent(value: Column, decimals: int = 1) -> Column:
    num = value.try_cast("double")
    return F.when(num.isNull(), "n/a").otherwise(F.concat(fixed_point(num * 100, decimals), F.lit("%")))


def _defined(value: Column) -> Column:
    """Null for NaN, which would count as larger than any number."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def shape_label(skew: Column) -> Column:
    skew = _defined(skew)
    return (
        F.when(skew > 1, "strongly right-skewed")
        .when(skew > 0.5, "right-skewed")
        .when(skew < -1, "strongly left-skewed")
        .when(skew < -0.5, "left-skewed")
        .otherwise("roughly symmetric")
    )


def transform_advice(skew: Column) -> Column:
    skew = _defined(skew)
    return F.when(skew > 1, "log").when(skew > 0.5, "square-root")


def confidence_label(score: Column) -> Column:
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for bound, label, _ in CONFIDENCE_STEPS:
        out = out.when(score >= bound, label)
    return out.otherwise(CONFIDENCE_FLOOR[0])


def confidence_color(score: Column) -> Column:
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for bound, _, color in CONFIDENCE_STEPS:
        out = out.when(score >= bound, color)
    return out.otherwise(CONFIDENCE_FLOOR[1])


def usable_question(question: Column) -> Column:
    return F.coalesce(F.length(F.btrim(question, F.lit(" \t\n\r\f\v"))) >= 5, F.lit(False))
