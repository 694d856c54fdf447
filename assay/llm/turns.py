"""Repair of conversations by lightest derivations.

A conversation must read as ``(s?(ua)+)?`` in the initials of its roles. Repair
items are (rows read, state of that pattern); an edit derives one item from
another at a cost and a letter. An agenda pops items by (cost, audit) until the
goal item is final: an edit never makes a derivation lighter, and at one item no
audit is the beginning of another of the same cost, so the order is monotone.

Conversations are cut into chunks of rows that are repaired apart, from every
state they can be entered in, and the spans are joined pairwise, so that one
conversation may hold any share of the rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from assay.llm.common import stored
from assay.operators.running import running_totals

# Costs of the edits, faults as they are numbered below.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SOUND, BLANK, DUPLICATE, CUT_SHORT = range(4)
BLANKS = " \t\n\x0b\x0c\r"
ENDINGS = ".!?"
#: States of the pattern: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
#: Rows that one agenda works on.
CHUNK_ROWS = 256


def _number(c: Column) -> Column:
    """A key for a value, null included."""
    return F.when(c.isNull(), "").otherwise(F.concat(F.lit("="), c.cast("string")))


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``_c, turn, role, text`` after the faults that crc32 of ``conv:turn``
    deals out: row dropped, text emptied, endings removed, row repeated, role user."""
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    dealt = F.crc32(F.concat(said(conv), F.lit(":"), said(turn))) % 20
    hurt = rows.select(_number(F.col(f"`{conv}`")).alias("_c"), F.col(f"`{turn}`").cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"), dealt.alias("_d")).where("_d <> 0")
    hurt = hurt.withColumn("text", F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ENDINGS, "")).otherwise(F.col("text")))
    hurt = hurt.withColumn("role", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")))
    return hurt.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_d") == 3, 2).otherwise(1)))).drop("_d")


def with_faults(rows: DataFrame) -> DataFrame:
    """Add ``idx`` (place in the conversation, from 1), ``chunk`` and ``fault``.

    Order: turn, nulls first, then a digest of role and text, then copies. The
    place comes from running totals over range partitions, the earlier twin from
    a minimum per digest, so neither needs a conversation in one task.
    """
    digest = F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), F.concat("role", "text")), 256))
    keyed = rows.withColumn("digest", digest).withColumn("_told", F.col("turn").isNotNull()).withColumn("_at", F.coalesce("turn", F.lit(0)))
    placed = running_totals(keyed, ["_told", "_at", "digest", "copy"], {"idx": F.lit(1)}, ["_c"]).drop("_told", "_at", "copy")
    first = placed.groupBy("_c", "digest").agg(F.min("idx").alias("first"))
    bare = F.rtrim("text", F.lit(BLANKS))
    fault = (
        F.when(bare == "", BLANK).when(F.col("idx") > F.col("first"), DUPLICATE)
        .when(~F.right(bare, F.lit(1)).isin(*ENDINGS), CUT_SHORT).otherwise(SOUND)
    )
    return placed.join(first, ["_c", "digest"]).withColumn("fault", fault.cast("int")).withColumn("chunk", F.floor((F.col("idx") - 1) / CHUNK_ROWS)).drop("digest", "first")


def agenda(start, deduce: Callable, goals=frozenset()) -> dict:
    """Lightest (cost, audit) of every item derivable from ``start``, in the
    order of their weights; ends as soon as one of ``goals`` is final."""
    queue, final = [(0, "", start)], {}
    while queue:
        cost, audit, item = heapq.heappop(queue)
        if item in final:
            continue
        final[item] = (cost, audit)
        if item in goals:
            break
        for step, letter, derived in deduce(item):
            if derived not in final:
                heapq.heappush(queue, (cost + step, audit + letter, derived))
    return final


def next_role(state: int) -> int:
    """State after the user or assistant turn that may follow."""
    return ASSISTANT if state == USER else USER


def deductions(initials: list[str], faults: list[int]) -> Callable:
    """The rules of a chunk: edits of the row at hand, or an inserted turn."""
    takes = {"u": (START, SYSTEM, ASSISTANT), "a": (USER,), "s": (START,)}
    gives = {"u": USER, "a": ASSISTANT, "s": SYSTEM}

    def deduce(item: tuple[int, int]):
        at, state = item
        yield INSERT, "I", (at, next_role(state))
        if at == len(faults):
            return
        yield DELETE, "D", (at + 1, state)
        if faults[at] not in (BLANK, DUPLICATE):
            more = TRUNCATED if faults[at] == CUT_SHORT else 0
            yield REROLE + more, "R", (at + 1, next_role(state))
            if state in takes.get(initials[at], ()):
                yield more, "K", (at + 1, gives[initials[at]])

    return deduce


def chunk_spans(initials: list[str], faults: list[int], entries: list[int]) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, audit) of the lightest repairs of a chunk."""
    deduce, n = deductions(initials, faults), len(faults)
    out = []
    for entry in entries:
        final = agenda((0, entry), deduce)
        out += [(entry, leave, *final[n, leave]) for leave in range(4) if (n, leave) in final]
    return out


def join_spans(left: list, right: list) -> list:
    """Spans over two neighbours: lightest by cost, then by audit."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for entry, middle, cost, audit in left:
        for enters, leave, more, rest in right:
            if enters == middle and (entry, leave) not in best or enters == middle and cost + more <= best[entry, leave][0]:
                best[entry, leave] = min(best.get((entry, leave), (cost + more, "\x7f")), (cost + more, audit + rest))
    return [(*k, *v) for k, v in best.items()]


_SPAN = "array<struct<entry:int,leave:int,cost:long,audit:string>>"
_CHUNK = f"_c string, chunk long, n long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string, spans {_SPAN}"
_CONV = "_c string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, pieces array<struct<chunk:long,entry:int,audit:string>>"
LEGAL = {"su", "ua", "au"}


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of equal keys in sorted rows, as row tuples."""
    key, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        at = [batch.schema.names.index(k) for k in keys]
        for row in zip(*columns):
            k = tuple(row[i] for i in at)
            if k != key and rows:
                yield key, rows
                rows = []
            key = k
            rows.append(row)
    if rows:
        yield key, rows


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _of_chunks(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (conv, chunk), found in _groups(batches, ("_c", "chunk")):
                turns, initials, faults = ([r[i] for r in found] for i in (3, 4, 5))
                told = [t for t in turns if t is not None]
                spans = chunk_spans(initials, faults, [START] if chunk == 0 else [START, SYSTEM, USER, ASSISTANT])
                yield (
                    conv, chunk, len(found), told[0] if told else None, told[-1] if told else None, len(set(told)),
                    *(faults.count(f) for f in (BLANK, DUPLICATE, CUT_SHORT)), sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
                    initials[0], initials[-1], [dict(zip(("entry", "leave", "cost", "audit"), s)) for s in spans],
                )

        return _batched(rows(), schema)

    return run


def state_after(emitted: int, has_system: bool) -> int:
    if emitted <= has_system:
        return SYSTEM if emitted and has_system else START
    return USER if (emitted - has_system) % 2 else ASSISTANT


def pieces_of(audit: str, sizes: list[int]) -> list[tuple[int, str]]:
    """(entry state, letters) of every chunk of ``sizes`` rows; inserted turns
    go with the row after them, the last with the row before."""
    total = len(audit) - audit.count("D")
    out, at, emitted = [], 0, 0
    for last, n in enumerate(sizes, 1 - len(sizes)):
        start = at
        while n:
            n -= audit[at] != "I"
            at += 1
        piece = audit[start:] if not last else audit[start:at]
        out.append((state_after(emitted, total % 2 == 1), piece))
        emitted += len(piece) - piece.count("D")
    return out


def _of_conversations(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (conv,), chunks in _groups(batches, ("_c",)):
                stack: list[tuple[int, list]] = []  # spans over 2^k chunks, long ones first
                low = high = tail = None
                turns = illegal = 0
                for c in chunks:
                    if c[5]:
                        turns += c[5] - (high is not None and c[3] == high)
                        low, high = c[3] if low is None else low, c[4]
                    illegal += c[9] + (tail is not None and tail + c[10] not in LEGAL)
                    tail = c[11]
                    size, spans = 1, [(s["entry"], s["leave"], s["cost"], s["audit"]) for s in c[12]]
                    while stack and stack[-1][0] == size:
                        spans, size = join_spans(stack.pop()[1], spans), 2 * size
                    stack.append((size, spans))
                spans = stack.pop()[1]
                while stack:
                    spans = join_spans(stack.pop()[1], spans)
                cost, audit = min((c, a) for e, leave, c, a in spans if e == START and leave in ACCEPTED)
                pieces = [{"chunk": c[1], "entry": e, "audit": a} for c, (e, a) in zip(chunks, pieces_of(audit, [c[2] for c in chunks]))]
                yield (conv, high - low + 1 - turns if turns else 0, *(sum(c[i] for c in chunks) for i in (6, 7, 8)), illegal, cost, audit, pieces)

        return _batched(rows(), schema, 500)

    return run


def _repaired_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the repaired turns, fed row by row in order."""
    names = {USER: "user", ASSISTANT: "assistant"}

    def rows():
        conv = digest = letters = None
        for batch in batches:
            for c, chunk, role, text, entry, audit in zip(*(batch.column(x).to_pylist() for x in ("_c", "chunk", "role", "text", "entry", "audit"))):
                if c != conv:
                    if conv is not None:
                        yield conv, digest.hexdigest()
                    conv, digest, letters, first = c, hashlib.sha256(), None, True
                if letters is None or letters[0] != chunk:
                    letters, state = (chunk, audit, 0), entry
                _, audit, at = letters
                done = False
                while at < len(audit) and (not done or "K" not in audit[at:] and "R" not in audit[at:] and "D" not in audit[at:]):
                    letter, at = audit[at], at + 1
                    done = done or letter != "I"
                    if letter == "D":
                        continue
                    if letter == "K":
                        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                        line = f"{role}:{text}"
                    else:
                        state = next_role(state)
                        line = f"{names[state]}:{text if letter == 'R' else ''}"
                    digest.update(("" if first else "\n").encode() + line.encode())
                    first = False
                letters = (chunk, audit, at)
        if conv is not None:
            yield conv, digest.hexdigest()

    return _batched(rows(), pa.schema([("_c", pa.string()), ("repaired_sha256", pa.string())]))


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damaged: bool = True) -> DataFrame:
    """One row per conversation: ``conv, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256``.

    ``damaged`` first deals out faults (``damage``). Null role and text are one
    space; a null id is a conversation of its own; null turns come first; rows
    of one turn are in the order of a digest of role and text. A conversation
    without rows has zeros, an empty audit and the digest of nothing; an empty
    table gives no rows. Other columns are not read. Only the digest, which is
    sequential by nature, streams a conversation through one task.
    """
    every = rows.select(F.col(f"`{conv}`").alias("_id")).distinct().withColumn("_c", _number(F.col("_id")))
    if damaged:
        turns = damage(rows, conv, turn, role, text)
    else:
        said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
        plain = rows.select(_number(F.col(f"`{conv}`")).alias("_c"), F.col(f"`{turn}`").cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"))
        turns = plain.withColumn("copy", F.lit(1))
    turns = stored(with_faults(turns), "turns")
    slim = turns.select("_c", "chunk", "idx", "turn", F.substring("role", 1, 1).alias("initial"), "fault")
    chunks = slim.repartition("_c", "chunk").sortWithinPartitions("_c", "chunk", "idx").mapInArrow(_of_chunks(_arrow(_CHUNK)), _CHUNK)
    judged = stored(chunks.repartition("_c").sortWithinPartitions("_c", "chunk").mapInArrow(_of_conversations(_arrow(_CONV)), _CONV), "repairs")
    pieces = judged.select("_c", F.explode("pieces").alias("p")).select("_c", "p.*")
    texts = turns.select("_c", "chunk", "idx", "role", "text").join(pieces, ["_c", "chunk"])
    digests = texts.repartition("_c").sortWithinPartitions("_c", "idx").mapInArrow(_repaired_digest, "_c string, repaired_sha256 string")
    out = every.join(judged, "_c", "left").join(digests, "_c", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("_id").alias(conv), *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
