"""How the sources of a language differ in their words, with late strings.

Counting moves 64-bit digests of the terms. One dictionary per digest keeps the
smallest and the largest string seen; where they differ, the digest's rows are
split by the string itself. Text comes back only for the rows that are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from assay.llm.common import LOWER, UPPER, slices, stored

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Fixed value: the scale of the integer probabilities.
SCALE = 1_000_000_000
#: Counts below it give a long when they are scaled.
LONG_COUNTS = (1 << 63) // SCALE - 1
#: Terms of groups that a task gathers before it adds them up, and passes them on if half are left.
TERMS_AT_ONCE = 1_000_000
#: Bytes of text whose terms are counted at a time.
TEXT_AT_ONCE = 1 << 22
#: Rows that a task passes on at a time.
ROWS_AT_ONCE = 100_000
#: Sources that are compared with all others at a time.
SOURCES_AT_ONCE = 64
#: Cells of a dense term-by-source table in one task.
CELLS_AT_ONCE = 1 << 20

# ASCII bytes of no term, and all bytes with A-Z in lower case and 0 for those: the same terms as bytes of UTF-8.
_OTHERS = bytes(b for b in range(128) if not chr(b).isalpha())
_FOLD = bytes.maketrans(UPPER.encode() + _OTHERS, LOWER.encode() + bytes(len(_OTHERS)))
_PARTS = "lang string, source string, term string, fresh boolean, n long, docs long"
_SCHEMA = "lang string, source string, part string, item string, value long, rank int"


def _terms_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts in their order as binary, and the number of each one's text."""
    text = text.cast(pa.large_string())
    edges = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = bytes(memoryview(text.buffers()[2])[edges[0] : edges[-1]]) if edges[-1] > edges[0] else b""
    edges, folded = edges - edges[0], raw.translate(_FOLD)
    inside = np.frombuffer(folded, np.uint8) != 0
    apart = np.zeros(len(folded) + 1, bool)  # between the byte before and this one
    apart[edges] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | apart[1:-1]
    closes[:-1] &= ~inside[1:] | apart[1:-1]
    starts = np.flatnonzero(opens)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(np.flatnonzero(closes) + 1 - starts, out=offsets[1:])
    terms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(folded.translate(None, b"\0"))])
    return terms, np.repeat(np.arange(len(text)), np.diff(np.searchsorted(starts, edges)))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in their order and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.diff(first, append=len(keys))


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """``lang, source, term, n, docs`` of a batch; a row without a term for every group."""
    words, doc = _terms_of(batch.column("text"))
    words, lang, source = (x.dictionary_encode() for x in (words, batch.column("lang"), batch.column("source")))
    groups, of = np.unique(lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(), return_inverse=True)
    code, width = words.indices.to_numpy(), max(1, len(words.dictionary))
    keys, n = _runs(of[doc] * width + code)
    once = _runs(doc * width + code)[0]
    docs = _runs(of[once // width] * width + once % width)[1]
    group, none = np.concatenate([keys // width, np.arange(len(groups))]), np.zeros(len(groups), np.int64)
    term = pa.array(np.concatenate([keys % width, none]), mask=np.arange(len(group)) >= len(keys))
    return pa.table({
        "lang": lang.dictionary.take(pa.array(groups[group] // len(source.dictionary))), "source": source.dictionary.take(pa.array(groups[group] % len(source.dictionary))),
        "term": words.dictionary.take(term), "n": np.concatenate([n, none]), "docs": np.concatenate([docs, none]),
    })


def _added(tables: list[pa.Table]) -> pa.Table:
    if len(tables) == 1:
        return tables[0]
    added = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return added.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def _marked(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The table as batches, ``fresh`` in the first row of every term."""
    words = table.column("term").combine_chunks().dictionary_encode()
    code = words.indices.fill_null(len(words.dictionary)).to_numpy()
    first = np.zeros(len(words.dictionary) + 1, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    fresh = np.zeros(len(code), bool)
    fresh[first[:-1]] = True
    out = table.set_column(2, "term", table.column("term").cast(pa.string())).add_column(3, "fresh", pa.array(fresh))
    yield from out.to_batches(ROWS_AT_ONCE)


def term_parts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """``lang, source, term, fresh, n, docs``: occurrences and documents, added
    up as far as a task's memory bound allows; a row without a term for every
    group. ``fresh`` marks one of the rows that a task gives out for a term at a
    time, which is enough for the dictionary. Texts are first dealt out so that
    a task has texts of few groups and most of a group's terms add up in it; a
    large group takes several tasks, by the places of its rows, so ``docs`` must
    have its rows in the same order whenever it is read, as files have."""
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    dealt = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange("lang", "source", "at").drop("at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for part in slices(batches, "text", TEXT_AT_ONCE):
            held.append(_counted(part))
            if sum(x.num_rows for x in held) > TERMS_AT_ONCE:
                held = [_added(held)]
                if 2 * held[0].num_rows > TERMS_AT_ONCE:
                    yield from _marked(held.pop())
        if held:
            yield from _marked(_added(held))

    return dealt.mapInArrow(run, _PARTS)


def _chance(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (n + 1) / (total + terms))`` in whole numbers, of longs where the product is one."""
    scaled = F.lit(SCALE).cast("decimal(20,0)") * (n + 1).cast("decimal(18,0)")
    large = F.call_function("div", scaled, (total + terms).cast("decimal(20,0)")).cast("long")
    return F.when(n < LONG_COUNTS, F.call_function("div", F.lit(SCALE).cast("long") * (n + 1), total + terms)).otherwise(large) + 1


F_DIV = "(({p} - {q}) * ({p} - {q})) div {q}"


def kept_terms(parts: DataFrame, least_docs: int, digest_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Counts of the terms in at least ``least_docs`` documents of their language:
    ``(cells, words)``.

    ``cells`` has ``lang, source, digest, tag, n``, the language's count ``c`` and
    ``first``, 1 in one row of a term of a language and 0 in the others; ``tag``
    is empty but for digests that two strings share, where it is the string.
    ``words`` has ``digest, low, high``. Rows meet by term once, for the counts of
    sources and language alike. Fewer ``digest_bits`` make collisions, which the
    tests do.
    """
    digest = F.xxhash64("term") if digest_bits == 64 else F.xxhash64("term").bitwiseAND(F.lit((1 << digest_bits) - 1))
    coded = parts.where("term is not null").withColumn("digest", digest)
    words = stored(coded.where("fresh").groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high")), "words")
    shared = words.where("low <> high").select("digest", F.lit(True).alias("split"))
    if shared.isEmpty():
        tagged = coded.withColumn("tag", F.lit(""))
    else:
        tagged = coded.join(shared, "digest", "left").withColumn("tag", F.when(F.col("split"), F.col("term")).otherwise(""))
    # The digest leads, as sorting by a long is the cheapest. A constant tag among the keys of the partitions would make Spark deal again.
    term = ["digest", "lang", "tag"]
    counted = tagged.repartition("digest", "lang").groupBy(*term, "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    one = Window.partitionBy(*term).orderBy("source")
    whole = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = counted.withColumns({"c": F.sum("n").over(whole), "docs": F.sum("docs").over(whole), "first": (F.row_number().over(one) == 1).cast("long")})
    return stored(cells.where(F.col("docs") >= least_docs).drop("docs"), "cells"), words


def _pair_sums(cells: DataFrame, groups: DataFrame, spare: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every two sources of a language.

    A term is one row with its non-zero chances by source number; the rest of a
    dense row are the sources' chances of an unseen term. A task adds up whole
    numbers per language and block of sources, so that what leaves it does not
    grow with the terms. Sums stay below 2^63, as chances add up to SCALE and
    the number of terms at most.
    """
    lists = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "none"))).alias("g")).withColumn("g", F.struct(F.col("g.source").alias("source"), F.col("g.none").alias("none")))
    numbered = groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).select("lang", "source", "at")
    rows = cells.join(numbered, ["lang", "source"]).groupBy("digest", "lang", "tag").agg(F.collect_list(F.struct("at", "p")).alias("x"))
    rows = rows.select("lang", F.col("x.at").alias("at"), F.col("x.p").alias("p")).join(lists.select("lang", F.col("g.none").alias("none")), "lang")
    blocks = F.sequence(F.lit(0), F.floor((F.size("none") - 1) / SOURCES_AT_ONCE).cast("int"))
    rows = rows.withColumn("block", F.explode(blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}

        def table() -> pa.RecordBatch:
            keys = list(sums)
            out = pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in keys], pa.string()), "block": pa.array([k[1] for k in keys], pa.int32()),
                                              "sums": pa.array([sums[k].ravel() for k in keys], pa.list_(pa.int64()))})
            sums.clear()
            return out

        for batch in batches:
            langs, ats, ps, nones, of = (batch.column(c) for c in ("lang", "at", "p", "none", "block"))
            sizes, names = np.diff(ats.offsets.to_numpy()), langs.to_numpy(zero_copy_only=False)
            starts, which = ats.offsets.to_numpy(), of.to_numpy()
            at, p = ats.values.to_numpy(), ps.values.to_numpy()
            for lang, block in {(l, int(b)) for l, b in zip(names, which)}:
                mine = np.flatnonzero((names == lang) & (which == block))
                none = nones[int(mine[0])].values.to_numpy()
                held = sums.setdefault((lang, block), np.zeros((min(SOURCES_AT_ONCE, len(none) - block * SOURCES_AT_ONCE), len(none)), np.int64))
                step = max(1, CELLS_AT_ONCE // len(none))
                for part in np.split(mine, range(step, len(mine), step)):
                    dense = np.tile(none, (len(part), 1))
                    flat = np.repeat(starts[part], sizes[part]) + np.arange(sizes[part].sum()) - np.repeat(np.cumsum(sizes[part]) - sizes[part], sizes[part])
                    dense[np.repeat(np.arange(len(part)), sizes[part]), at[flat]] = p[flat]
                    for i in range(len(held)):
                        d = dense[:, [block * SOURCES_AT_ONCE + i]] - dense
                        held[i] += (d * d // dense).sum(0)
                if sum(x.size for x in sums.values()) > CELLS_AT_ONCE:
                    yield table()
        if sums:
            yield table()

    partial = rows.mapInArrow(run, "lang string, block int, sums array<long>")
    added = partial.select("lang", "block", F.posexplode("sums").alias("cell", "value")).groupBy("lang", "block", "cell").agg(F.sum("value").alias("value"))
    width = F.size("g.source")
    named = added.join(lists, "lang").withColumn("_i", (F.col("block") * SOURCES_AT_ONCE + F.floor(F.col("cell") / width)).cast("int")).withColumn("_j", (F.col("cell") % width).cast("int"))
    sums = named.where("_i <> _j").select("lang", F.col("g.source")[F.col("_i")].alias("source"), F.col("g.source")[F.col("_j")].alias("item"), "value")
    # Languages without a kept term list their pairs all the same.
    bare = spare.groupBy("lang").agg(F.collect_list("source").alias("s")).select("lang", F.explode("s").alias("source"), "s")
    bare = bare.select("lang", "source", F.explode("s").alias("item"), F.lit(0).cast("long").alias("value")).where("source <> item")
    return sums.unionByName(bare)


def divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 3, top: int = 200,
    digest_bits: int = 64,
) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair``: every other source of the language with the divergence of the
    group from it; part ``term``: the ``top`` kept terms that the group uses
    more than its language does. Null text, lang and source are empty texts;
    a repeated row counts as a document of its own; other columns are not read.
    A group without terms has its chances all the same; without kept terms the
    pairs have value 0. Ties of a value are ranked by the item's bytes. An empty
    table gives no rows. The pairs are S times S rows for S sources, which is
    the result itself; no other step emits pairs.
    """
    parts = stored(term_parts(docs, text, lang, source), "parts")
    cells, words = kept_terms(parts, least_docs, digest_bits)
    of_lang = cells.groupBy("lang").agg(F.sum("first").alias("v"), F.sum("n").alias("total"))
    of_group = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    every = parts.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    every = stored(every.withColumn("n", F.coalesce("n", F.lit(0).cast("long"))), "groups")
    groups = every.where("v is not null").select("lang", "source", "n", "v", "total", _chance(F.lit(0).cast("long"), F.col("n"), F.col("v")).alias("none"))
    sizes = groups.select("lang", "source", F.col("n").alias("group_n"), "v", "total")
    chances = cells.join(sizes, ["lang", "source"]).select(
        "lang", "source", "digest", "tag", _chance(F.col("n"), F.col("group_n"), F.col("v")).alias("p"), _chance(F.col("c"), F.col("total"), F.col("v")).alias("q")
    )
    chances = stored(chances, "chances")
    pairs = _pair_sums(chances.drop("q"), groups, every.where("v is null"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    over = chances.where("p > q").select("lang", "source", "digest", "tag", F.expr(F_DIV.format(p="p", q="q")).alias("value"))
    # Candidates by value alone, first in slices of a group, then in the group; all ties stay until the text is back.
    sliced = Window.partitionBy("lang", "source", "slice").orderBy(F.desc("value"))
    near = over.withColumn("slice", F.pmod("digest", F.lit(16))).withColumn("r", F.rank().over(sliced)).where(F.col("r") <= top).drop("r", "slice")
    near = near.withColumn("r", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("r") <= top)
    texts = near.join(words, "digest").withColumn("item", F.when(F.col("tag") == "", F.col("low")).otherwise(F.col("tag")))
    best = texts.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank")).where(F.col("rank") <= top)
    return ranked.unionByName(best).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
