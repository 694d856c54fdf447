"""Quality rules with thresholds that follow each language and source.

Per-text measures are whole numbers. A sketch of a measure counts its values in
buckets of three leading digits: sketches of any two sets of rows merge by
adding counts, and quantiles are off by less than one in a hundred. Thresholds
are fences over a group's own quantiles; a group with few rows takes those of
its language, or of the whole table, from the merged sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assay.llm.common import stored

# Quantiles of a group, how many spreads of a measure its fences
# are away, and how many occurrences are few, in a text of the group's median
# size and in any text.
QUANTILES = {"low": (1, 10), "middle": (1, 2), "upper": (2, 3), "high": (9, 10)}
REACH = 4
SLACK, FEW = 3, 2
LEAST_ROWS = 100
#: Measures that are shares of a size; most texts have none of what they count.
SHARES = {"symbol_share": ("n_symbols", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines")}
_GAP = r"[\x20\x09-\x0D]+"


def measure(docs: DataFrame, keys: list[str], text: str = "text", window: int = 8) -> DataFrame:
    """``keys`` and the measures of every row. A null text has no words.

    Arrays are computed in steps of their own, each used as a column of the
    next, so that none is evaluated twice.
    """
    t = F.coalesce(F.col("_t"), F.lit(""))
    words = docs.select(*keys, F.col(text).alias("_t")).select(
        *keys,
        F.array_remove(F.split(t, _GAP), "").alias("_w"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    hashed = words.select(
        *keys, "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    # The hash of a window is made from those of its halves.
    step = 1
    while step < window:
        hashed = hashed.withColumn("_h", F.zip_with("_h", F.slice("_h", step + 1, F.greatest(F.size("_h") - step, F.lit(0))), lambda a, b: F.xxhash64(a, b)))
        step *= 2
    hashed = hashed.withColumn("_h", F.slice("_h", 1, F.greatest(F.size("_h") - (window - 1), F.lit(0))))
    hashed = hashed.withColumn("_repeats", F.size(F.array_distinct("_h")) < F.size("_h"))
    placed = hashed.withColumn("_h", F.when(F.col("_repeats"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    twins = F.zip_with(
        "_h", F.slice("_h", 2, F.greatest(F.size("_h") - 1, F.lit(0))),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])).otherwise(F.array().cast("array<int>")),
    )
    placed = placed.withColumn("_p", F.sort_array(F.array_distinct(F.flatten(twins))))
    reach = F.zip_with("_p", F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window)))
    repeated = F.coalesce(F.aggregate(reach, F.lit(0).cast("long"), lambda acc, x: acc + x), F.lit(0).cast("long"))
    return placed.select(*keys, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeated.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def values() -> dict[str, Column]:
    """What the sketches count: word length and shares in thousandths, and the
    sizes; null for a text without words."""
    def per(a: str, b: str) -> Column:
        return F.expr(f"case when {b} > 0 then 1000 * {a} div {b} end")

    sizes = {size: F.expr(f"case when {size} > 0 then {size} end") for _, size in SHARES.values()}
    return {"word_length": per("word_chars", "n_words"), **{m: per(*of) for m, of in SHARES.items()}, **sizes}


def bucket(value: Column) -> Column:
    """The value cut to three leading digits."""
    unit = F.pow(F.lit(10), F.greatest(F.length(value.cast("string")) - 3, F.lit(0))).cast("long")
    return value - value % unit


def sketch(measured: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, measure, bucket, n``: one row per occupied bucket."""
    pairs = F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in values().items()])
    counted = measured.select(*groups, F.inline(pairs)).where("value is not null")
    return counted.groupBy(*groups, "measure", bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, measure, rows`` and the quantiles of the merged sketches."""
    by = [*groups, "measure"]
    merged = sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by)
    ranked = merged.withColumn("_rows", F.sum("n").over(group)).withColumn("_upto", F.sum("n").over(group.orderBy("bucket")))
    # The smallest bucket that at least the wanted share of rows do not exceed.
    return ranked.groupBy(*by).agg(
        F.max("_rows").alias("rows"), *[F.min(F.when(F.col("_upto") * b >= F.col("_rows") * a, F.col("bucket"))).alias(q) for q, (a, b) in QUANTILES.items()]
    )


def fences(of: DataFrame) -> DataFrame:
    """The fences of each group from its quantiles, one row per group.

    Word length may be ``REACH`` spreads from the median; the spread is the
    smaller one of the two sides, which junk on one side does not widen, and at
    least a bucket's width. A share may exceed the quantile at two thirds, which
    a third of junk does not reach, by ``SLACK`` occurrences in a text of the
    group's median size.
    """
    width = F.pow(F.lit(10), F.greatest(F.length(F.col("word_length_middle").cast("string")) - 3, F.lit(0))).cast("long")
    spread = F.greatest(F.least(F.col("word_length_high") - F.col("word_length_middle"), F.col("word_length_middle") - F.col("word_length_low")), width)
    out = of.withColumn("word_length_lowest", F.col("word_length_middle") - REACH * spread).withColumn("word_length_highest", F.col("word_length_middle") + REACH * spread)
    for name, (_, size) in SHARES.items():
        out = out.withColumn(f"{name}_highest", F.col(f"{name}_upper") + F.expr(f"{1000 * SLACK} div {size}_middle"))
    return out


def thresholds(measured: DataFrame, lang: str, source: str) -> DataFrame:
    """One row per language and source with its quantiles and fences."""
    fine = stored(sketch(measured.select(F.col(lang).alias("_lang"), F.col(source).alias("_source"), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"), ["_lang", "_source"]), "sketch")
    own, of_lang, of_all = quantiles(fine, ["_lang", "_source"]), quantiles(fine, ["_lang"]), quantiles(fine, [])
    chosen = (
        own.alias("o")
        .join(of_lang.alias("l"), F.col("o._lang").eqNullSafe(F.col("l._lang")) & (F.col("o.measure") == F.col("l.measure")))
        .join(F.broadcast(of_all).alias("a"), F.col("o.measure") == F.col("a.measure"))  # a row per measure
    )

    def pick(name: str) -> Column:
        return F.when(F.col("o.rows") >= LEAST_ROWS, F.col(f"o.{name}")).when(F.col("l.rows") >= LEAST_ROWS, F.col(f"l.{name}")).otherwise(F.col(f"a.{name}")).alias(name)

    flat = chosen.select(F.col("o._lang").alias("_lang"), F.col("o._source").alias("_source"), F.col("o.measure").alias("measure"), *map(pick, QUANTILES))
    sides = [F.max(F.when(F.col("measure") == m, F.col(q))).alias(f"{m}_{q}") for m in values() for q in QUANTILES]
    return fences(flat.groupBy("_lang", "_source").agg(*sides))


def judge(docs: DataFrame, keys: list[str], lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``keys``, the measures, ``base_failed`` and ``kept`` for every row.

    A text that fails the base rules goes; else it stays while every measure
    lies within the fences of its language and source or counts ``FEW`` at most (null is a group like any
    other). A null text has no words and fails. Repeated rows are judged alike;
    an empty table gives no rows; columns not named are not read.
    """
    columns = list(dict.fromkeys([*keys, lang, source]))
    measured = stored(measure(docs, columns, text), "measures")
    limits = stored(thresholds(measured, lang, source), "fences")
    joined = measured.join(limits, measured[lang].eqNullSafe(limits["_lang"]) & measured[source].eqNullSafe(limits["_source"]), "left")
    of = values()
    inside = F.coalesce(of["word_length"].between(F.col("word_length_lowest"), F.col("word_length_highest")), F.lit(True))
    for name, (count, _) in SHARES.items():
        inside = inside & F.coalesce((F.col(count) <= FEW) | (of[name] <= F.col(f"{name}_highest")), F.lit(True))
    return joined.select(
        *[measured[k].alias(k) for k in keys], "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"),
    )


def keep_good(docs: DataFrame, row_id: str = "doc_id", lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, all columns as they were.

    Rows are recognised by id, language, source and text, so ids that are null
    or occur twice are judged row by row.
    """
    keys = ["_id", "_hash", "_lang", "_source"]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(row_id).alias("_id"), F.xxhash64(F.col(text)).alias("_hash"),
        F.col(lang).alias("_lang"), F.col(source).alias("_source"), F.col(text).alias("_body"),
    )
    judged = judge(rows, keys, "_lang", "_source", "_body")
    good = judged.where("kept").select(*[F.col(c).alias(f"good{c}") for c in keys]).distinct()
    same = F.lit(True)
    for c in keys:
        same = same & rows[c].eqNullSafe(good[f"good{c}"])
    return rows.join(good, same, "left_semi").select("_row.*")
