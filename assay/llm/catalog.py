"""Registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from assay.llm import divergence, lines, lm, packing, pieces, pivots, quality, repeats, secrets, simhash, tokens, turns, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op1_sentencepiece")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs, path = table(spark, folder, "documents"), tokenizer_file("piece_bpe_32k.model")
    return pieces.with_digest(pieces.encode(docs, path), path)


OP2_SQL = """
with recursive v as (
    select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
    where label is not null and embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs as (
    select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
    where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98
), reach(x, y) as (
    select vec_id, vec_id from embeddings union select r.x, p.y from reach r join pairs p on p.x = r.y
), lowest as (select x, min(y) as component_id from reach group by x),
degree as (select x, count(*) as n from pairs group by x)
select e.vec_id, coalesce(d.n, 0)::bigint as n_links, l.component_id, e.vec_id = l.component_id as kept
from embeddings e join lowest l on l.x = e.vec_id left join degree d on d.x = e.vec_id
"""


@query("op2_embedding_dedup", OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.near_duplicate_vectors(table(spark, folder, "embeddings"))


@query("op3_url_filter")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    labelled = spark.createDataFrame(urls.labelled_urls(), "url string, label int")
    return urls.judge_urls(table(spark, folder, "pages"), urls.train_url_model(labelled)).drop("score")


@query("op4_secret_scan")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", secrets.spans_text(F.col("secrets")).alias("spans"),
        F.size(F.filter("secrets", lambda s: s["live"])).cast("long").alias("n_live"),
    )


@query("op5_simhash_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


OP6_SQL = f"""
with cut as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as n from cut),
big as (select *, strlen(line) as size from l where strlen(line) >= {lines.LEAST_BYTES}),
firsts as (select line, size, min(struct_pack(d := doc_id, n := n)) as at from big group by line, size),
gone as (
    select distinct b.line from firsts a, firsts b
    where a.size between b.size - {lines.EDITS} and b.size + {lines.EDITS} and a.at < b.at and levenshtein(a.line, b.line) <= {lines.EDITS}
), stay as (
    select l.doc_id, l.n, l.line, strlen(l.line) < {lines.LEAST_BYTES} or (f.at = struct_pack(d := l.doc_id, n := l.n) and g.line is null) as ok
    from l left join firsts f on f.line = l.line left join gone g on g.line = l.line
)
select doc_id, count(*) as n_lines, count(*) filter (not ok) as n_removed,
       md5(coalesce(string_agg(line, chr(10) order by n) filter (ok), '')) as text_md5
from stay group by doc_id
"""


@query("op6_line_dedup", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = lines.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def _fence_sql() -> str:
    per = {"word_length": "1000 * word_chars // n_words", **{m: f"1000 * {a} // {b}" for m, (a, b) in quality.SHARES.items()}, "n_words": "n_words", "n_lines": "n_lines"}
    size = {m: "n_lines" if m in ("dup_line_share", "n_lines") else "n_words" for m in per}
    union = " union all ".join(f"select lang, source, '{k}' as measure, {v} as v from m where {size[k]} > 0" for k, v in per.items())
    quant = ", ".join(f"min(case when upto * {b} >= rows * {a} then bucket end) as q_{q}" for q, (a, b) in quality.QUANTILES.items())

    def level(name: str, by: list[str]) -> str:
        keys = "".join(f"{c}, " for c in by)
        return f"""
        {name}_c as (select {keys}measure, bucket, count(*) as n from sk group by all),
        {name}_r as (select *, sum(n) over (partition by {keys}measure) as rows, sum(n) over (partition by {keys}measure order by bucket) as upto from {name}_c),
        {name} as (select {keys}measure, max(rows) as rows, {quant} from {name}_r group by {keys}measure)"""

    least, reach = quality.LEAST_ROWS, quality.REACH
    picked = ", ".join(f"case when o.rows >= {least} then o.q_{q} when l.rows >= {least} then l.q_{q} else a.q_{q} end as q_{q}" for q in quality.QUANTILES)
    wide = ", ".join(f"max(q_{q}) filter (measure = '{m}') as {m}_{q}" for m in per for q in quality.QUANTILES)
    spread = "greatest(least(word_length_high - word_length_middle, word_length_middle - word_length_low), (10 ** greatest(length(word_length_middle::varchar) - 3, 0))::bigint)"
    inside = f"coalesce(1000 * word_chars // nullif(n_words, 0) between word_length_middle - {reach} * {spread} and word_length_middle + {reach} * {spread}, true)"
    for m, (a, b) in quality.SHARES.items():
        inside += f" and coalesce({a} <= {quality.FEW} or 1000 * {a} // nullif({b}, 0) <= {m}_upper + {1000 * quality.SLACK} // {b}_middle, true)"
    return f"""
    sk as (select lang, source, measure, v - v % (10 ** greatest(length(v::varchar) - 3, 0))::bigint as bucket from ({union})),
    {level("own", ["lang", "source"])}, {level("ofl", ["lang"])}, {level("oall", [])},
    picked as (
        select o.lang, o.source, o.measure, {picked}
        from own o join ofl l on l.lang is not distinct from o.lang and l.measure = o.measure join oall a on a.measure = o.measure
    ), t as (select lang, source, {wide} from picked group by lang, source)
    select m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
           not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and {inside} as kept
    from m left join t on t.lang is not distinct from m.lang and t.source is not distinct from m.source"""


OP7_SQL = f"""
with d as (
    select doc_id, lang, source, coalesce(text, '') as t,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls
    from documents
), win as (
    select doc_id, i, hash(list_slice(w, i, i + 7)) as h from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)
), twice as (select doc_id, i from win qualify count(*) over (partition by doc_id, h) > 1),
gaps as (select doc_id, least(8, coalesce(lead(i) over (partition by doc_id order by i) - i, 8)) as g from twice),
rep as (select doc_id, sum(g)::bigint as n from gaps group by doc_id),
m as (
    select d.doc_id, lang, source, len(w) as n_words, coalesce(length(array_to_string(w, '')), 0) as word_chars,
           length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
           len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words
    from d left join rep on rep.doc_id = d.doc_id
), {_fence_sql()}
"""


@query("op7_quality_rules", OP7_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents"), ["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_token_counts")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query("op9_lm_scores")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_texts(table(spark, folder, "documents"))


@query("op10_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_file("byte_bpe_50k.json"))


OP13_SQL = r"""
with d as (
    select coalesce(lang, '') as lang, coalesce(source, '') as source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
    from documents
), o as (select lang, source, unnest(w) as t, 0 as first from d union all select lang, source, unnest(list_distinct(w)) as t, 1 as first from d),
k as (select lang, t, sum(1 - first) as c from o group by all having sum(first) >= 3),
n as (select lang, source, t, sum(1 - first) as n from o semi join k using (lang, t) group by all),
l as (select lang, count(*)::hugeint as v, sum(c)::hugeint as total from k group by all),
gs as (select distinct lang, source from d),
g as (select gs.lang, gs.source, coalesce(sum(n.n), 0)::hugeint as size from gs left join n using (lang, source) group by all),
p as (
    select g.lang, g.source, k.t, coalesce(n.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n.n, 0) + 1)) // (g.size + l.v) as p,
           1 + (1000000000::hugeint * (k.c + 1)) // (l.total + l.v) as q
    from g join l using (lang) join k using (lang) left join n on n.lang = g.lang and n.source = g.source and n.t = k.t
), pairs as (
    select a.lang, a.source, b.source as item, (select coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) from p x join p y on x.lang = y.lang and x.t = y.t
            where x.lang = a.lang and x.source = a.source and y.source = b.source) as value
    from gs a join gs b on a.lang = b.lang and a.source <> b.source
), terms as (select lang, source, t as item, ((p - q) * (p - q)) // q as value from p where n > 0 and p > q)
select lang, source, 'pair' as part, item, value::bigint as value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
union all
select * from (select lang, source, 'term' as part, item, value::bigint as value, row_number() over (partition by lang, source order by value desc, item)::int as rank from terms) where rank <= 200
"""


@query("op13_source_divergence", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(table(spark, folder, "documents"))


def _repair_sql() -> str:
    """Repair by a recursive table of the four states; a state is its cost in
    nine digits, its audit, and after a chr(1) the repaired lines."""

    def edit(state: str, cost: str, letter: str, line: str = "''") -> str:
        return f"(printf('%09d', substr({state}, 1, 9)::int + {cost}) || replace(substr({state}, 10), chr(1), '{letter}' || chr(1)) || {line})"

    def said(role: str, text: str) -> str:
        return f"chr(10) || {role} || ':' || {text}"

    def least(*of: str) -> str:
        return f"least({', '.join(of)})"

    insert_user = [edit(s, "5", "I", said("'user'", "''")) for s in ("s0", "s1", "s3")]
    closed = f"(select *, {least('n3', edit('n2', '5', 'I', said(repr('assistant'), repr(''))))} as m3 from (select *, s3 as n3, {least('s2', *insert_user)} as n2 from st))"
    more = "(case when fault = 3 then 5 else 0 end)"

    def when(condition: str, value: str) -> str:
        return f"case when fault not in (1, 2) and {condition} then {value} end"

    def rerole(s: str, role: str) -> str:
        return when("true", edit(s, f"1 + {more}", "R", said(f"'{role}'", "text")))

    def keep(s: str, initial: str) -> str:
        return when(f"role[1] = '{initial}'", edit(s, more, "K", said("role", "text")))

    delete = {s: edit(s, "2", "D") for s in ("s0", "s1", "n2", "m3")}
    new = {
        "s0": delete["s0"], "s1": least(delete["s1"], keep("s0", "s")),
        "s2": least(delete["n2"], *[f(s, x) for s in ("s0", "s1", "m3") for f, x in ((rerole, "user"), (keep, "u"))]),
        "s3": least(delete["m3"], rerole("n2", "assistant"), keep("n2", "a")),
    }
    crc = (
        "xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(k, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1]))),"
        " lambda c, b: xor(xor(c, greatest(b, 0)) >> 1, 3988292384 * (xor(c, greatest(b, 0)) & 1))), 4294967295)"
    )
    blanks = " || ".join(f"chr({n})" for n in (32, 9, 10, 11, 12, 13))
    return f"""
with recursive src as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations
), dealt as (select *, {crc} % 20 as d from src),
hurt as (
    select conv_id, turn, case when d = 4 then 'user' else role end as role,
           case when d = 1 then '' when d = 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when d = 3 then 2 else 1 end)) as copy
    from dealt where d <> 0
), placed as (select *, row_number() over (partition by conv_id order by turn nulls first, copy) as i, rtrim(text, {blanks}) as b from hurt),
r as (
    select *, case when b = '' then 1 when row_number() over (partition by conv_id, role, text order by i) > 1 then 2 when right(b, 1) not in ('.', '!', '?') then 3 else 0 end as fault,
           role[1] || lead(role[1]) over (partition by conv_id order by i) as pair
    from placed
), st as (
    select distinct conv_id, 0::bigint as i, '000000000' || chr(1) as s0, null::varchar as s1, null::varchar as s2, null::varchar as s3 from conversations
    union all
    select c.conv_id, c.i + 1, {new["s0"]}, {new["s1"]}, {new["s2"]}, {new["s3"]} from {closed} c join r on r.conv_id = c.conv_id and r.i = c.i + 1
), counts as (
    select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank,
           count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
    from r group by conv_id
), best as (select c.conv_id, {least("s0", "m3")} as x, i from {closed} c)
select b.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
       substr(x, 1, 9)::bigint as cost, string_split(substr(x, 10), chr(1))[1] as audit, sha256(substr(string_split(x, chr(1))[2], 2)) as repaired_sha256
from best b left join counts using (conv_id) where b.i = coalesce(n, 0)
"""


OP11_SQL = _repair_sql()


@query("op11_conversation_repair", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return turns.repair_conversations(table(spark, folder, "conversations"))


@query("op12_repeated_strings")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents"))
