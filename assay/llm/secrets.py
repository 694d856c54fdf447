"""Secret scan with corpus-wide ownership frequency.

Candidates are found per text. A value that turns up under several owners is an
example that people copy (a tutorial's key, a default password); one that stays
with a single owner looks live.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from assay.llm.common import stored, texts_of

# The three kinds of spans, in their order, and the added kind.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "token")
_LONG_WORD = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_MIXED = re.compile(r"(?=.*[A-Z])(?=.*[0-9])", re.DOTALL)


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind, end, value)`` of the three listed kinds, sorted."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def token_spans(text: str, taken: list[tuple[int, int, int, str]], least_bits: float) -> list[tuple[int, int, int, str]]:
    """Long words of capitals and digits, and maybe more, at high entropy, apart from ``taken`` (in order)."""
    out, starts = [], [s[0] for s in taken]
    # The furthest end of the spans up to each one: the word meets one of them if it lies beyond the word's start.
    reach = list(accumulate((s[2] for s in taken), max))
    for m in _LONG_WORD.finditer(text):
        before = bisect_left(starts, m.end())
        free = not before or reach[before - 1] <= m.start()
        if free and _MIXED.match(m[0]) and entropy(m[0]) >= least_bits:
            out.append((m.start(), 3, m.end(), m[0]))
    return out


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64()), ("value", pa.binary())])


def scan(docs: DataFrame, columns: list[str], text: str = "text", least_bits: float = 3.0) -> DataFrame:
    """``columns``, ``uid`` (a number of the row), the listed spans' counts and
    digest, and ``found``: every candidate with a 128-bit digest of its value."""
    rows = docs.select(*columns, F.col(text).alias("_text"))

    def run(batches):
        base, seen = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digests, spans = [], []
            for t in texts_of(batch.column("_text")):
                listed = base_spans(t)
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in listed))
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in listed).encode()).hexdigest())
                spans.append(
                    [{"start": a, "kind": k, "stop": b, "value": xxhash.xxh3_128_digest(v.encode("utf-8", "surrogatepass"))} for a, k, b, v in listed + token_spans(t, listed, least_bits)]
                )
            n = batch.num_rows
            uid = pa.array(range(base + seen, base + seen + n), pa.int64())
            seen += n
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [uid, *[pa.array(c, pa.int64()) for c in counts], pa.array(digests), pa.array(spans, pa.list_(_SPAN))],
                [*columns, "uid", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    fields += ["uid long, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:long,kind:int,stop:long,value:binary>>"]
    return rows.mapInArrow(run, ", ".join(fields))


def ownership(candidates: DataFrame, min_owners: int, min_repositories: int) -> DataFrame:
    """``value`` and ``live``: false where at least ``min_owners`` owners or
    ``min_repositories`` repositories hold the value. Counts combine per value
    and owner before they meet, so a value in every document stays cheap."""
    per_owner = candidates.select("value", "owner", "repository").distinct().groupBy("value", "owner").agg(F.count("*").alias("n"))
    spread = per_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    return spread.select("value", ((F.col("owners") < min_owners) & (F.col("repositories") < min_repositories)).alias("live"))


def find_secrets(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", owner: str = "source", repository: tuple[str, ...] = ("source", "lang"),
    min_owners: int = 3, min_repositories: int = 6, least_bits: float = 3.0, with_columns: tuple[str, ...] = (),
) -> DataFrame:
    """``row_id``, counts and digest of the listed spans and ``secrets``: an
    array of ``(start, kind, stop, live)`` by start and kind.

    Listed spans always stay; the added kind stays where it looks live. A null
    text is empty, a null owner or repository is an owner of its own, repeated
    rows are scanned and returned one by one, extra columns are not read, and an
    empty table gives no rows.
    """
    names = [row_id, *with_columns]
    prepared = docs.select(
        *names, F.col(text).alias("_t"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner"),
        F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository]).alias("_repository"),
    )
    scanned = stored(scan(prepared, [*names, "_owner", "_repository"], "_t", least_bits), "spans")
    candidates = scanned.select("uid", F.col("_owner").alias("owner"), F.col("_repository").alias("repository"), F.inline("found"))
    verdicts = stored(ownership(candidates, min_owners, min_repositories), "owners")
    judged = (
        candidates.join(verdicts, "value").where("kind < 3 or live")
        .groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "live"))).alias("secrets"))
    )
    out = scanned.drop("found", "_owner", "_repository").join(judged, "uid", "left").drop("uid")
    empty = F.array().cast("array<struct<start:long,kind:int,stop:long,live:boolean>>")
    return out.withColumn("secrets", F.coalesce("secrets", empty))


def spans_text(secrets: F.Column) -> F.Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, row_id: str = "doc_id", text: str = "text", owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), mark: str = "[SECRET]", **knobs) -> DataFrame:
    """All rows and columns of ``docs``, with the spans that look live replaced
    by ``mark`` in ``text``; widely copied examples stay as they are."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    names = {f"_repository{n}": c for n, c in enumerate(repository)}
    rows = docs.select(row, F.col(row_id).alias("_id"), F.col(text).alias("_body"), F.col(owner).alias("_held_by"), *[F.col(c).alias(n) for n, c in names.items()])
    found = find_secrets(rows, "_id", "_body", "_held_by", tuple(names), with_columns=("_row",), **knobs)
    live = found.select("_row", F.col(f"_row.`{text}`").alias("_text"), F.filter("secrets", lambda s: s["live"]).alias("_spans"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t, spans in zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist()):
            parts, at = [], 0
            for s in spans:
                if s["start"] >= at:
                    parts += [t[at : s["start"]], mark]
                at = max(at, s["stop"])
            out.append(t if not spans else "".join(parts) + t[at:])
        return pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(out, pa.string())], ["_row", "_text"])

    row_type = live.schema["_row"].dataType.simpleString()
    cleaned = live.mapInArrow(lambda batches: map(step, batches), f"_row {row_type}, _text string")
    return cleaned.select(*[F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
