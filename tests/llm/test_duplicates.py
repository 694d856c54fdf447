"""Embeddings, SimHash and line dedup against brute force."""

import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from assay.llm import blocks, lines, pivots, simhash
from assay.llm.graph import components
from tests.llm.conftest import ROWS, words


def roots(n, links):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        at[b] = a
    return [find(x) for x in range(n)]


def test_components(llm_spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(None, 3), (5, 5)]
    got = {r[0]: r[1] for r in components(llm_spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    clean = [x for x in links if None not in x]
    want = roots(200, clean)
    assert got == {x: want[x] for l in clean for x in l if l[0] != l[1]} | {x: want[x] for x in got}
    assert components(llm_spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_blocks_compare_every_pair_of_a_key_once(llm_spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, 5]), i) for i in range(60)]
    placed = blocks.to_blocks(llm_spark.createDataFrame(rows, "key long, id long"), ["key"], "id", 5, 10).toPandas()
    seen = []
    for _, part in placed.groupby("block"):
        ids = part["id"].to_numpy()
        blocks.pairs_in_block(*[part[c].to_numpy() for c in ("key", "chunk", "first_chunk", "last_chunk")], lambda i, j: seen.extend(tuple(sorted(x)) for x in zip(ids[i], ids[j])))
    assert sorted(seen) == sorted((a, b) for k, a in rows for j, b in rows if k == j and a < b)


def vectors(rng, n):
    out = []
    for i in range(n):
        v = rng.normal(size=16)
        out.append((i, int(rng.integers(3)), [float(x) for x in v]))
        for _ in range(int(rng.integers(0, 4)) if i % 9 == 0 else 0):
            out.append((n + len(out), out[-1][1], [float(x) for x in v + rng.normal(size=16) * 0.1]))
    return out


@pytest.mark.parametrize("chunk", [3, 1024])
def test_vectors(llm_spark, chunk):
    rows = vectors(np.random.default_rng(3), 120)
    rows += [(900, 1, rows[0][2]), (901, rows[0][1], rows[0][2]), (902, rows[0][1], rows[0][2]), (903, None, rows[0][2]), (904, 1, None), (905, 1, []), (906, 1, [0.0] * 16)]
    rows += [(907, 1, [float("nan")] * 16), (908, 1, [None] * 16), (909, 1, [1.0, 2.0]), (910, 1, [1.0, 2.0])]
    df = llm_spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r["vec_id"]: tuple(r)[1:] for r in pivots.near_duplicate_vectors(df, pivots=32, chunk=chunk).collect()}
    good = lambda v: v and None not in v and np.isfinite(v).all() and any(v)
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    links = [
        (i, j) for i, a in enumerate(rows) for j, b in enumerate(rows)
        if i < j and a[1] is not None and a[1] == b[1] and good(a[2]) and good(b[2]) and len(a[2]) == len(b[2]) and cos(a[2], b[2]) >= 0.98
    ]
    degree = np.bincount([x for l in links for x in l], minlength=len(rows))
    of = roots(len(rows), links)
    low = {}
    for i, r in enumerate(of):
        low[r] = min(low.get(r, 10**9), rows[i][0])
    for i, r in enumerate(rows):
        assert got[r[0]] == (degree[i], low[of[i]], r[0] == low[of[i]]), r
    assert pivots.near_duplicate_vectors(df.limit(0)).count() == 0


def plain_simhash(text, k=4):
    w = [x.encode().lower().decode() for x in words(text)]
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(odd, empty, llm_spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(40)) for _ in range(60)) for _ in range(12)]
    texts = [(r[0], r[3]) for r in ROWS] + [(100 + i, b + f" tail {i % 3}") for i, b in enumerate(base * 3)] + [(200, "one two"), (201, "ONE two"), (202, "One Two")]
    df = llm_spark.createDataFrame(texts, "doc_id long, text string")
    fps = [plain_simhash(t) for _, t in texts]
    of = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    low = {}
    for i, r in enumerate(of):
        if texts[i][0] is not None:
            low[r] = min(low.get(r, 10**9), texts[i][0])
    want = sorted(((t[0], f"{f:016x}", low.get(r)) for t, f, r in zip(texts, fps, of)), key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str) == want
    kept = simhash.keep_one(df, shingle_words=4).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(low.get(r)) for r in set(of))
    assert simhash.keep_one(odd).columns == odd.columns
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_pigeonhole_keys_find_every_close_pair(llm_spark):
    rng = random.Random(6)
    center = rng.getrandbits(64)
    near = {center}
    while len(near) < 60:
        near.add(rng.choice(sorted(near)) ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 4))}))
    near = sorted(near)
    of = roots(len(near), [(i, j) for i in range(len(near)) for j in range(i) if (near[i] ^ near[j]).bit_count() <= 4])
    signed = [x - (1 << 64) if x >> 63 else x for x in near]
    found = {r["fp"]: r["group"] for r in simhash.fingerprint_components(llm_spark.createDataFrame([(x,) for x in signed], "fp long"), chunk=7).collect()}
    assert len({found.get(x, x) for x in signed}) == len(set(of))


def test_edit_distance_and_segments():
    rng = random.Random(7)
    left, right = [], []
    for _ in range(600):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 90)))
        b = bytearray(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 1)] = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 1)))
        left.append(a), right.append(bytes(b))
    for edits in (1, 2, 3):
        want = [lines._plain_distance(a, b) <= edits for a, b in zip(left, right)]
        assert lines.edit_distance_within(left, right, edits).tolist() == want
        for a, b, near in zip(left, right, want):
            a, b = (a, b) if len(a) >= len(b) else (b, a)
            if near and len(b) > edits:
                own = {(len(b), i, b[s : s + w]) for i, (s, w) in enumerate(lines.segments(len(b), edits))}
                assert own & {(o, i, a[s : s + w]) for o, i, s, w in lines.probes(len(a), edits)}
                assert (lines.letters(a) ^ lines.letters(b)).bit_count() <= 2 * edits


def test_line_dedup(odd, empty, llm_spark):
    rng = random.Random(8)
    stock = ["".join(rng.choice("abcdefgh ") for _ in range(40)) for _ in range(12)]

    def vary(x):
        x = list(x)
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(len(x))] = rng.choice("éxyz")
        return "".join(x)

    rows = [(i, "\n".join(vary(rng.choice(stock)) if rng.random() < 0.8 else "short" for _ in range(rng.randint(0, 6)))) for i in range(40)] + [(41, None), (41, "b" * 50), (41, "a" * 50)]
    got = sorted(map(str, (tuple(r) for r in lines.dedup_lines(llm_spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text", "n_lines", "n_removed").collect())))
    seen, want = [], []
    for i, t in rows[:-2]:
        stay = []
        for x in (t or "").split("\n"):
            b = x.encode()
            if len(b) < lines.LEAST_BYTES or all(abs(len(b) - len(s)) > 2 or lines._plain_distance(b, s) > 2 for s in seen):
                stay.append(x)
            if len(b) >= lines.LEAST_BYTES:
                seen.append(b)
        n = len((t or "").split("\n"))
        want.append((i, None if t is None else "\n".join(stay), n, n - len(stay)))
    want += [(41, "b" * 50, 1, 0), (41, "a" * 50, 1, 0)]
    assert got == sorted(map(str, want))
    cleaned = lines.dedup_lines(odd)
    assert cleaned.columns == [*odd.columns, "n_lines", "n_removed"] and len(cleaned.collect()) == len(ROWS)
    assert lines.dedup_lines(empty).count() == 0


def test_short_lines_repeat_exactly(llm_spark):
    rows = [(1, "Les.\n\nLes.\nLes!\n漢字の行\n  "), (2, "漢字の行\n\nkept\n  \nLes."), (3, "kept"), (4, "a line of more than 24 bytes\nown"), (5, "a line of more than 24 bytez\nown")]
    df = llm_spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.dedup_lines(df, short_repeats=True).collect()}
    assert got == {1: ("Les.\n\nLes!\n漢字の行\n  ", 1), 2: ("\nkept\n  ", 2), 3: ("", 1), 4: (rows[3][1], 0), 5: ("", 2)}
    cleaned = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(llm_spark, df, "").collect()}
    assert cleaned == {1: got[1][0], 2: got[2][0], 4: got[4][0]}


def test_vectors_whose_norm_overflows_link(llm_spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1e200, 1e200], 0), (3, [1e-200, 1e-200], 0), (4, [1e308, -1e308], 0), (5, [5e-324, 5e-324], 0), (6, [float("inf"), 1.0], 0)]
    df = llm_spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivots.near_duplicate_vectors(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 5: (3, 1), 4: (0, 4), 6: (0, 6)}


@pytest.mark.parametrize("hot, chunk", [(16, 256), (4, 5)])
def test_many_near_lines_give_no_pairs(llm_spark, monkeypatch, hot, chunk):
    rng = random.Random(12)
    base = "a line that many documents have with a small edit or two of it"
    made = []
    for i in range(120):
        line = list(base)
        for _ in range(rng.randrange(5)):
            at, c = rng.randrange(len(line)), rng.choice("abcdefgh")
            line[at : at + rng.randrange(2)] = [c] * rng.randrange(1, 3) if rng.random() < 0.7 else []
        made.append((i, "".join(line) if i % 7 else "".join(rng.choice("xyz") for _ in range(21)) + base[21:]))
    counts, stored = {}, lines.stored

    def counting(df, name, *by):
        out = stored(df, name, *by)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(lines, "stored", counting)
    monkeypatch.setattr(lines, "HOT_ROWS", hot, raising=False)
    monkeypatch.setattr(lines, "CHUNK", chunk, raising=False)
    df = llm_spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(df).collect()}
    want = {i: int(any(j < i and lines._plain_distance(b.encode(), a.encode()) <= 2 for j, b in made)) for i, a in made}
    assert got == want and 30 < sum(want.values()) < 110
    assert counts["pairs"] <= 8 * len(made)  # of 7 140


def test_keeping_one_of_a_group_moves_no_texts(llm_spark, monkeypatch):
    rng = random.Random(13)
    rows = [(i, " ".join(str(rng.random()) for _ in range(12))) for i in range(6000)]
    rows += [(10_000 + i, t) for i, t in rows[:20]]
    monkeypatch.setattr(simhash, "fingerprint_components", lambda marked, *a: llm_spark.createDataFrame([], "fp long, group long"))
    before = llm_spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    llm_spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8000")
    try:
        kept = simhash.keep_one(llm_spark.createDataFrame(rows, "doc_id long, text string"))
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect())
    finally:
        llm_spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert ids == list(range(6000)) and "SortMergeJoin" not in plan
