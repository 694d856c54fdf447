"""Conversation repair, repeated strings, suffix order, source divergence."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assay.llm import divergence, induced, repeats, turns
from tests.llm.conftest import ROWS


# --- conversations ---------------------------------------------------------------------------------------------------

BLANK = re.compile(r"[\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def order_key(row):
    _, turn, role, text = row
    digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
    return (turn is not None, turn or 0, digest)


def all_repairs(rows, faults, most_inserts):
    """Every edit sequence of a short conversation, by trying them all."""
    pattern = re.compile(r"(s?(ua)+)?")
    best = None
    choices = [("D",) if f in (1, 2) else ("K", "Ru", "Ra", "D") for f in faults]
    slots = len(rows) + 1
    for edits in itertools.product(*choices):
        for n in range(most_inserts + 1):
            for where in itertools.combinations_with_replacement(range(slots), n):
                for what in itertools.product("ua", repeat=n):
                    audit, roles, lines, cost = "", "", [], 0
                    for i in range(slots):
                        for w, x in zip(where, what):
                            if w == i:
                                audit, roles, cost = audit + "I", roles + x, cost + 5
                                lines.append({"u": "user:", "a": "assistant:"}[x])
                        if i == len(rows):
                            break
                        e, (_, _, role, text) = edits[i], rows[i]
                        audit += e[0]
                        cost += {"K": 0, "R": 1, "D": 2}[e[0]] + (5 if e != "D" and faults[i] == 3 else 0)
                        if e != "D":
                            roles += (role[:1] or "?") if e == "K" else e[1]
                            lines.append(f"{role if e == 'K' else {'u': 'user', 'a': 'assistant'}[e[1]]}:{text}")
                    if pattern.fullmatch(roles):
                        best = min(best or (cost, audit, lines), (cost, audit, lines))
    return best


def brute_repair(rows, most_inserts=3):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damaged(rows) if r[0] == conv), key=order_key)
        faults, seen = [], set()
        for _, _, role, text in mine:
            bare = BLANK.sub("", text)
            faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, text))
        told = [r[1] for r in mine if r[1] is not None]
        cost, audit, lines = all_repairs(mine, faults, most_inserts)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        gaps = max(told) - min(told) + 1 - len(set(told)) if told else 0
        out[conv] = (gaps, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed, n):
    rng, rows = random.Random(seed), []
    texts = ["Hi.", "Hi.", "Why?", "so", "well and", "", " \t\n", "No!", None, "Ends. \n"]
    for conv in range(n):
        for turn in range(rng.randrange(5)):
            at = rng.choice([turn, turn, turn + 3, None])
            rows.append((rng.choice([conv, conv, None if conv == 5 else conv]), at, rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(texts)))
    by_conv = defaultdict(list)
    for r in rows:
        by_conv[r[0]].append(r)
    return [r for rows_of in by_conv.values() for r in rows_of[:4]]


CONV_SCHEMA = "conv_id long, turn long, role string, text string"


def repaired(df):
    return {r[0]: tuple(r[1:]) for r in turns.repair_conversations(df).collect()}


def test_repair_equals_trying_every_edit(llm_spark):
    rows = conversations(5, 40)
    from pyspark.sql import functions as F

    df = llm_spark.createDataFrame(rows, CONV_SCHEMA).withColumns({c: F.lit("own") for c in ("_c", "chunk", "idx", "fault", "audit", "cost", "copy", "digest")})
    want = brute_repair(rows)
    got = repaired(df)
    assert got.keys() == want.keys()
    assert {k: v for k, v in got.items() if v != want[k]} == {}
    assert {len(v) for v in got.values()} == {8}
    assert repaired(df.limit(0)) == {}


@pytest.mark.parametrize("chunk_rows", [1, 2, 3, 7])
def test_chunks_do_not_change_a_repair(llm_spark, monkeypatch, chunk_rows):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "b", "C!", "", f"{t}?"])) for c, n in ((1, 40), (2, 7), (3, 1)) for t in range(n)]
    df = llm_spark.createDataFrame(rows, CONV_SCHEMA)
    whole = repaired(df)
    monkeypatch.setattr(turns, "CHUNK_ROWS", chunk_rows)
    assert repaired(df) == whole


def test_conversation_without_rows(llm_spark):
    gone = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = repaired(llm_spark.createDataFrame([(gone, 0, "user", "Hi.")], CONV_SCHEMA))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


# --- suffix order and repeated strings ------------------------------------------------------------------------------

@pytest.mark.parametrize("limit,block", [(1, 1), (2, 7), (5, 64), (1000, 3), (1000, 1 << 18)])
def test_suffix_order_and_common_prefixes(monkeypatch, limit, block):
    """Small limits send every list through scratch files and the recursion."""
    monkeypatch.setattr(induced, "BLOCK", block)
    rng, cap = random.Random(limit), 5
    for _ in range(80):
        letters = rng.choice([1, 2, 3, 9])
        text = bytes(rng.randint(1, letters) for _ in range(rng.randrange(60))) + b"\0"
        n = len(text)
        tape = induced.sort_suffixes(np.frombuffer(text + bytes(cap), np.uint8), n, limit, cap)
        at, common = tape.read(0, tape.size)
        assert at.tolist() == sorted(range(n), key=lambda i: text[i:], reverse=True)
        for i in range(1, n):
            pair = zip(text[at[i - 1] :], text[at[i] :])
            assert common[i] == min(cap, sum(1 for _ in itertools.takewhile(lambda x: x[0] == x[1], pair)))


def brute_repeats(rows, length):
    first, out = {}, []
    name = lambda i: repeats.NO_ID if i is None else i
    coded = [(i, (t or "").encode()) for i, t in rows]
    for i, b in coded:
        for a in range(len(b) - length + 1):
            w = b[a : a + length]
            first[w] = min(first.get(w, name(i)), name(i))
    for i, b in coded:
        gone = bytearray(len(b))
        for a in range(len(b) - length + 1):
            if first[b[a : a + length]] < name(i):
                gone[a : a + length] = b"\1" * length
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def repeated_rows():
    rng = random.Random(3)
    words = ["the ", "wolf ", "über ", "fox\n", "a", "jumps "]
    base, rows = "".join(rng.choice(words) for _ in range(400)), []
    for i in range(60):
        at = rng.randrange(len(base))
        rows.append((rng.choice([i, i, i // 2, None]), base[at : at + rng.randrange(300)] + "".join(rng.choice(words) for _ in range(rng.randrange(60)))))
    hot = [(200 + i, f"{i} begins " + base[:120] + f" ends {i}") for i in range(80)]
    return rows + hot + [(1, None), (2, ""), (100, "x" * 3000), (101, "x" * 2000), (3, "x" * 49), (4, "x" * 50)]


@pytest.mark.parametrize("length,sizes", [(50, {}), (50, dict(portion_bytes=2000, shard_bytes=1000, bucket_keys=50, tuples=64)), (12, dict(portion_bytes=500, shard_bytes=4000, bucket_keys=500, tuples=8))])
def test_repeated_strings(llm_spark, length, sizes):
    rows = repeated_rows()
    df = llm_spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, repeats.remove_repeats(df, length=length, **sizes).collect()), key=str)
    assert got == brute_repeats(rows, length)


def test_repeated_strings_of_odd_rows(llm_spark, odd, empty):
    rows = [(r[0], r[3]) for r in ROWS]
    got = repeats.remove_repeats(odd, with_text=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute_repeats(rows, 50)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert repeats.remove_repeats(empty).count() == 0


# --- source divergence ----------------------------------------------------------------------------------------------

def brute_divergence(rows, least=3, top=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, lang, source, text in rows:
        found = re.findall(divergence.TERM, (text or "").translate(lower))
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        keep = [t for t, n in docs[lang].items() if n >= least]
        mine = {s: {t: c[t] for t in keep} for (l, s), c in groups.items() if l == lang}
        v = len(keep)

        def p(counts):
            return {t: 1 + 10**9 * (n + 1) // (sum(counts.values()) + v) for t, n in counts.items()}

        chances = {s: p(c) for s, c in mine.items()}
        whole = p({t: sum(c[t] for c in mine.values()) for t in keep})
        for s in mine:
            pairs = [(-sum((chances[s][t] - chances[o][t]) ** 2 // chances[o][t] for t in keep), o.encode()) for o in mine if o != s]
            terms = [(-((chances[s][t] - whole[t]) ** 2 // whole[t]), t.encode()) for t in keep if mine[s][t] and chances[s][t] > whole[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(sorted(found), 1) if part == "pair" or rank <= top]
    return sorted(out)


def divergent_rows():
    rng = random.Random(4)
    words = ["Wolf", "wolf", "über", "Über", "naïve", "fox", "x1y2", "語", "😀", "\x00a\x7fb", "zebra", "Emu"]
    return [
        (i, rng.choice(["en", "de", None, "fr"]), rng.choice("abcd") if i % 11 else None, " ".join(rng.choices(words, k=rng.randrange(30))) if i % 13 else rng.choice([None, ""]))
        for i in range(150)
    ] + [(900, "xx", "lone", "only here"), (901, "yy", "a", ""), (902, "yy", "b", None)]


@pytest.mark.parametrize("bits,most", [(64, 200), (2, 200), (64, 2)])
def test_divergence(llm_spark, bits, most):
    """Two bits of digest make most terms collide."""
    rows = divergent_rows()
    df = llm_spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").repartition(3)
    got = sorted(map(tuple, divergence.divergence(df, top=most, digest_bits=bits).collect()))
    assert got == brute_divergence(rows, top=most)


def test_divergence_in_small_steps(llm_spark, monkeypatch):
    rows = divergent_rows()
    for name, value in (("TERMS_AT_ONCE", 3), ("SOURCES_AT_ONCE", 2), ("CELLS_AT_ONCE", 5)):
        monkeypatch.setattr(divergence, name, value)
    df = llm_spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    assert sorted(map(tuple, divergence.divergence(df).collect())) == brute_divergence(rows)


def test_divergence_of_odd_rows(odd, empty):
    assert sorted(map(tuple, divergence.divergence(odd, least_docs=1).collect())) == brute_divergence(ROWS, 1)
    assert divergence.divergence(empty).count() == 0


def test_terms_of_a_group_add_up_in_few_tasks(llm_spark):
    """Texts of eight groups lie in all of twelve partitions."""
    words = [f"w{'abcdefghij'[i]}" for i in range(10)]
    rows = [(i, "en", f"s{i // 12 % 8}", " ".join(words)) for i in range(12 * 96)]
    df = llm_spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").repartitionByRange(12, "doc_id")
    parts = divergence.term_parts(df, "text", "lang", "source").collect()
    tasks = int(llm_spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(parts) <= (8 + min(tasks, 12)) * 11 < 12 * 8 * 11
    found = Counter()
    for r in parts:
        found[r["source"], r["term"]] += r["n"]
        assert r["n"] == r["docs"] and (r["term"] is None) == (r["n"] == 0)
    assert found == Counter({(f"s{s}", w): 144 if w else 0 for s in range(8) for w in [*words, None]})


def test_terms_of_texts_side_by_side():
    """Texts lie in one run of bytes; a term ends with its text."""
    rng = random.Random(7)
    texts = ["", "ab", "cd", "", "Ab1\x00\x7f", "\u00fcber\u00dc", "z", " ", "\U0001f600x", "@[`{Az"] + ["".join(rng.choices("aZ\u00e9\u8a9e 1-", k=rng.randrange(12))) for _ in range(300)] + [""]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for part in (pa.array(texts), pa.array(texts).slice(3, 40), pa.array(["", ""]), pa.array(["1"]), pa.array(["x" * 70_000]), pa.array(["a", "b"], pa.large_string())):
        terms, of = divergence._terms_of(part)
        want = [(i, t) for i, text in enumerate(part.to_pylist()) for t in re.findall(divergence.TERM, text.translate(lower))]
        assert list(zip(of.tolist(), terms.cast(pa.string()).to_pylist())) == want


def test_divergence_of_texts_in_slices(llm_spark, monkeypatch):
    rows = divergent_rows()
    for name, value in (("TEXT_AT_ONCE", 20), ("TERMS_AT_ONCE", 30), ("ROWS_AT_ONCE", 7)):
        monkeypatch.setattr(divergence, name, value)
    df = llm_spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    assert sorted(map(tuple, divergence.divergence(df).collect())) == brute_divergence(rows)


def test_chances_beyond_long_products(llm_spark):
    counts = [0, 5, divergence.LONG_COUNTS - 1, divergence.LONG_COUNTS, divergence.LONG_COUNTS + 1, 10**12]
    df = llm_spark.createDataFrame([(n, 3 * n + 1, 7) for n in counts], "n long, total long, v long")
    got = df.select("n", divergence._chance(F.col("n"), F.col("total"), F.col("v")).alias("p")).collect()
    assert {r["n"]: r["p"] for r in got} == {n: 1 + 10**9 * (n + 1) // (3 * n + 8) for n in counts}


def test_every_operator_is_registered():
    """A broken import inside the subpackage would leave them out without a word."""
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if re.match(r"op\d", n)} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert {"op2_embedding_dedup", "op6_line_dedup", "op7_quality_rules", "op11_conversation_repair", "op13_source_divergence"} <= set(entry.oracle_sql())


def test_strings_of_a_shard_by_hashes_and_by_order(monkeypatch):
    rng = random.Random(21)
    for length in (2, 3, 8, 50, 120):
        texts = list({bytes(rng.choice(b"ab") for _ in range(length + rng.randrange(9))) + bytes(rng.choice(b"abc") for _ in range(3)) for _ in range(40)})
        texts += [t[: length + 2] for t in texts if len(t) > length + 2]
        least = np.array([rng.randrange(30) for _ in texts])
        low = {}
        for t, d in zip(texts, least):
            for i in range(len(t) - length + 1):
                low[t[i : i + length]] = min(low.get(t[i : i + length], 99), d)
        want = {(k, i) for k, t in enumerate(texts) for i in range(len(t) - length + 1) if low[t[i : i + length]] < least[k]}
        spread = lambda runs: {(k, at) for k, begin, long in runs for at in range(begin, begin + long)}
        assert want and spread(repeats._equal_strings(texts, least, length)) == want
        assert spread(repeats._ordered_strings(texts, least, length, 1 << 20)) == want
        with monkeypatch.context() as m:  # strings that differ never count as one
            m.setattr(repeats, "string_hashes", lambda data, length: np.zeros(len(data) - length + 1, np.uint64))
            assert repeats._equal_strings(texts, least, length) is None
    keys, sizes = np.array([1, 1, 2, 3, 3, 3, 4]), np.array([4, 4, 3, 9, 9, 9, 1])
    assert [(p.start, p.stop) for p in repeats._whole_keys(keys, sizes, 11)] == [(0, 3), (3, 6), (6, 7)]
    assert list(repeats._whole_keys(keys[:0], sizes[:0], 11)) == []
