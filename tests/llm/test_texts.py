"""Pieces, token counts, packing and language-model scores."""

import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from assay.llm import lm, packing, pieces, tokens
from assay.llm.catalog import tokenizer_file
from assay.llm.common import slices
from assay.llm.eliasfano import EliasFano
from tests.llm.conftest import ROWS, words

BITS = ["a", "b", "the", "tion", "  ", " ", "   ", "é", "\n", "0", "12", "▁", "漢", "🙂", "ing", "s", "(", ".", "==", "\t", "<s>", "\x00", "'ll"]


def noise(rng, n):
    return "".join(rng.choice(BITS) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(tokenizer_file("piece_bpe_32k.model"))


def test_pieces_equal_the_library(model):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    rng = random.Random(1)
    for _ in range(300):
        x = noise(rng, rng.randint(0, 30))
        ids = np.frombuffer(model.encode_whole(pieces.normalise(x)), "<u4")
        assert ids.tolist() == library.encode(x), x
        assert model.decode(ids) == x.replace("▁", " ")


def test_chunks_meet_at_their_borders(model):
    rng = random.Random(2)
    for k in range(40):
        x = pieces.normalise(noise(rng, 80) if k % 2 else "".join(rng.choice("abcdethino") for _ in range(200)))
        size, parts, places = rng.choice([16, 20, 33]), [], []
        for n, b in enumerate(range(0, len(x), size)):
            lo, e = max(0, b - model.longest), min(len(x), b + size)
            y = x[lo : e + model.longest]
            entries = model.entries(y, b - lo) if n else [pieces.START]
            exits, matrix = model.transfer(y, b - lo, e - lo, entries)
            parts.append((entries, exits, matrix))
            places.append((y, b - lo, e - lo))
        found = pieces.settle(parts)
        ids = sum([model.between(*p, f[0], f[1]) for p, f in zip(places, found)], [])
        assert ids == np.frombuffer(model.encode_whole(x), "<u4").tolist()


def test_encoding_keeps_no_words(model):
    rng = random.Random(4)
    model.encode_whole(pieces.normalise("a first text"))
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        for _ in range(20):
            model.encode_whole(pieces.normalise(" ".join("".join(rng.choice("abcdethino") for _ in range(8)) for _ in range(2000))))
        model.encode_whole(pieces.normalise(" ".join("".join(rng.choice("abcdethino") for _ in range(2000)) for _ in range(20))))
        assert tracemalloc.get_traced_memory()[0] - before < 6_000_000
    finally:
        tracemalloc.stop()


def test_many_texts_at_once_equal_the_library(model):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    rng = random.Random(5)
    texts = ["", "", " ", "a" * 70, "ab" * 40, " " * 90, "漢" * 65, "x\U0001f642", "\ue000\ue001\n\x00", "  end  "]
    texts += [noise(rng, rng.randint(0, 60)) if k % 2 else "".join(rng.choice("abcdethino ,") for _ in range(rng.randint(0, 90))) for k in range(600)]
    ids = model.encode_all([pieces.normalise(t) for t in texts]).to_pylist()
    assert [np.frombuffer(b, "<u4").tolist() for b in ids] == library.encode(texts)
    assert model.encode_all([]).to_pylist() == [] and model.encode_all(["", ""]).to_pylist() == [b"", b""]
    assert pieces.decode_all(ids, tokenizer_file("piece_bpe_32k.model")) == [t.replace("▁", " ") for t in texts]
    with pytest.raises(ValueError):
        pieces.decode_all([np.array([library.unk_id()], "<u4").tobytes()], tokenizer_file("piece_bpe_32k.model"))


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_pydict({"k": list(range(7)), "t": ["", "a" * 5, None, "b" * 40, "", "é", "c" * 3]})
    parts = list(slices([batch.slice(0, 0), batch.slice(1)], "t", 6))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(1, 7))
    assert [p.column("k").to_pylist() for p in parts] == [[1, 2, 3], [4, 5, 6]]


def test_max_plus_product_is_associative():
    r = np.random.default_rng(0)
    a, b, c = (np.where(r.random(s) < 0.4, -np.inf, -r.integers(0, 9, s).astype(float)) for s in ((3, 4), (4, 5), (5, 2)))
    assert np.array_equal(pieces.combine(pieces.combine(a, b), c), pieces.combine(a, pieces.combine(b, c)))


def test_encode_whole_and_in_chunks(odd, empty):
    path = tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted(str((r[0], library.encode(r[3] or ""))) for r in ROWS)
    for size in (64, 1 << 15):
        encoded = pieces.encode(odd, path, chunk_chars=size)
        assert sorted(str((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist())) for r in encoded.collect()) == want
    texts = {(r["doc_id"], r["text"]) for r in pieces.decode(encoded, path).collect()}
    assert texts == {(r[0], r[3] or "") for r in ROWS}
    assert pieces.encode(empty, path).count() == 0


def test_token_counts(odd, empty):
    path = tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = sorted(map(str, ((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.token_counts(odd, path).collect())))
    want = [(r[0], len((r[3] or "").encode()), n := len(library.encode(r[3] or "", add_special_tokens=False).ids), n > 512) for r in ROWS]
    assert got == sorted(map(str, want))
    assert tokens.token_counts(empty, path).count() == 0


def test_token_counter_on_noise():
    path = tokenizer_file("byte_bpe_50k.json")
    library, counter, rng = Tokenizer.from_file(path), tokens.TokenCounter(path), random.Random(3)
    texts = [noise(rng, rng.randint(0, 40)) + rng.choice(["", "<|endoftext|>", "\x1c\x1f", "  ", "aaaaaaaaaa" * 9]) for _ in range(300)]
    assert counter.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [counter._count_long(t) for t in texts] == counter.count(texts)


def test_packing(odd, empty):
    ranks, library = [tokenizer_file(f"byte_bpe_50k.{kind}") for kind in ("tiktoken", "json")], Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    rows = packing.pack_documents(odd, *ranks, window=256, with_ids=True).collect()
    sequences, ids = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        data = np.frombuffer(r["ids"], "<u4")
        assert len(data) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        ids[r["doc_id"], r["doc_tokens"]].append((r["start"], data.tolist()))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at & (at - 1) == 0 and at <= 256
    want = [library.encode(r[3] or "", add_special_tokens=False).ids + [0] for r in ROWS]
    assert sum(map(len, want)) == sum(r["length"] for r in rows)
    # The ids of a document, in order and once each; equal rows are told apart by nothing and share a key.
    for key in {(r[0], len(w)) for r, w in zip(ROWS, want)}:
        texts = [w for r, w in zip(ROWS, want) if (r[0], len(w)) == key]
        assert all(w == texts[0] for w in texts)
        at = Counter()
        for start, part in ids[key]:
            assert part == texts[0][start : start + len(part)]
            at.update(range(start, start + len(part)))
        assert at == Counter({i: len(texts) for i in range(key[1])})
    assert packing.pack_documents(empty, *ranks).count() == 0


@pytest.mark.parametrize("blank", [" ", "\n", " \n\t"])
def test_packing_of_very_long_white_space(llm_spark, blank):
    text = "Some words" + blank * (2_000_000 // len(blank)) + "and more."
    ranks = [tokenizer_file(f"byte_bpe_50k.{kind}") for kind in ("tiktoken", "json")]
    want = Tokenizer.from_file(ranks[1]).encode(text, add_special_tokens=False).ids + [0]
    rows = packing.pack_documents(llm_spark.createDataFrame([(1, text)], "doc_id long, text string"), *ranks, with_ids=True).collect()
    got = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in sorted(rows, key=lambda r: r["start"])])
    assert got.tolist() == want
    for n in (99_990, 100_001, 150_000):  # both ways to encode agree
        some = "x" + blank * n + "y"
        assert packing.encode_text(some, *ranks, (("<|endoftext|>", 50256),)).tolist() == Tokenizer.from_file(ranks[1]).encode(some, add_special_tokens=False).ids


def test_step_groups_are_balanced_across_tasks(llm_spark):
    rng = random.Random(7)
    rows = [(i, "word " * int(rng.paretovariate(0.8) * 20 % 3000)) for i in range(3000)]
    ranks = [tokenizer_file(f"byte_bpe_50k.{kind}") for kind in ("tiktoken", "json")]
    packed = packing.pack_documents(llm_spark.createDataFrame(rows, "doc_id long, text string").repartition(7), *ranks, group_tokens=2048)
    sums, sizes = Counter(), defaultdict(set)
    for r in packed.collect():
        sums[r["step_group"]] += r["length"]
        sizes[r["tier"]].add(r["step_group"])
    assert {1024, 512, 256, 128, 64} <= set(sizes)
    for groups in sizes.values():
        whole = sorted(groups)[:-1]
        assert all(sums[g] == 2048 for g in whole) and 0 < sums[max(groups)] <= 2048


def test_packer_covers_every_id_once():
    rng, packer = random.Random(5), packing.TierPacker(1024, 64)
    sizes = [int(rng.paretovariate(1) * 50) % 5000 + 1 for _ in range(800)]
    full, left = packer.pack(sizes)
    for sequence in full:
        total = sum(p[2] for p in sequence)
        # A window is as long as the tier of the piece it begins with, and what fills its gap is shorter.
        assert total in packer.tiers and min(t for t in packer.tiers if t >= sequence[0][2]) == total
        assert all(p[2] <= total - sequence[0][2] for p in sequence[1:])
    assert {sum(p[2] for p in s) for s in full} >= {1024, 512, 256}  # short pieces may all have gone into gaps
    last = Counter()
    for doc, start, n in sorted(p for s in full + packer.finish(left) for p in s):
        assert last[doc] == start
        last[doc] += n
    assert [last[d] for d in range(len(sizes))] == sizes


def test_elias_fano():
    r = np.random.default_rng(1)
    for universe, n in ((1 << 64, 3000), (1 << 20, 1000), (3000, 2500), (10, 3), (1 << 63, 1)):
        values = np.unique(r.integers(0, universe, n, dtype=np.uint64))
        coded = EliasFano(values)
        asked = np.concatenate([values, r.integers(0, universe, 500, dtype=np.uint64)])
        assert np.array_equal(coded.value(np.arange(len(values))), values)
        assert np.array_equal(coded.successor(asked), np.searchsorted(values, asked))
        assert np.array_equal(coded.find(asked) >= 0, np.isin(asked, values))
    assert EliasFano(np.empty(0, np.uint64)).find(np.array([1], np.uint64)).tolist() == [-1]


def brute_scores(rows, mu):
    toks = [[w.encode().lower().decode() for w in words(r[1])] + ["\n"] for r in rows]
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows]
    c, b = Counter(), Counter()
    for t, h in zip(toks, held):
        if not h:
            c.update(t)
            b.update(zip(["\n"] + t, t))
    n, v = sum(c.values()), len(c)
    p = lambda w: (c[w] + 1) / (n + v + 1)
    return [
        (r[0], h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(p(w)) for w in t), sum(math.log10((b[x, w] + mu * p(w)) / (c[x] + mu)) for x, w in zip(["\n"] + t, t)))
        for r, t, h in zip(rows, toks, held)
    ]


@pytest.mark.parametrize("shard_tokens", [40, 10**6])
def test_scores(odd, empty, monkeypatch, shard_tokens):
    got = lm.score_texts(odd, shard_tokens=shard_tokens, count_shards=3).collect()
    want = brute_scores([(r[0], r[3]) for r in ROWS], 1000.0)
    key = lambda x: (x[0] is None, x[0] or 0, round(x[5], 6))
    got, want = sorted([tuple(r) for r in got], key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5]) and abs(g[6] - w[6]) <= w[2] * (0.5 / lm.STEPS + 1e-9)
    assert lm.score_texts(empty).count() == 0


def test_scores_of_a_text_over_several_portions(llm_spark, monkeypatch):
    monkeypatch.setattr(lm, "TOKENS_AT_ONCE", 7)

    class Batch:
        num_rows = 3

        def column(self, name):
            import pyarrow as pa

            return pa.array(["a b c d e f g h i j k", "", "x y"]) if name == "_text" else pa.array([False, True, False])

    tokens_, contexts = [], []
    for before, names, ids, docs in lm._portions([Batch()]):
        assert sum(d[2] for d in docs) == len(ids)
        tokens_ += [names[i] for i in ids]
        contexts.append(before)
    assert tokens_ == b"a b c d e f g h i j k".split() + [b"\n", b"\n", b"x", b"y", b"\n"]
    assert contexts[0] == 0 and contexts[1] == lm.xxhash.xxh3_64_intdigest(b"g")


def test_a_portion_without_all_its_answers_fails():
    run, one = lm._add_up(10, 3, 1000.0), np.array([1], np.int64).tobytes()
    tokens = lm.pa.table({"portion": [1], "shards": [2], "places": [one], "ids": [one], "sizes": [b"\1\0\0\0"], "pairs": [b"\0\0\0"]})
    reply = {"shard": 0, "portion": 1, "known": one, "word_runs": b"\1\0\0\0", "codes": bytes([lm.UNSEEN])}
    schema = lm.pa.Table.from_pylist([reply]).schema
    for found in ([], [reply], [reply] * 3):
        with pytest.raises(RuntimeError):
            run(tokens, lm.pa.Table.from_pylist(found, schema))
    with pytest.raises(RuntimeError):
        run(tokens.slice(0, 0), lm.pa.Table.from_pylist([reply], schema))
    added = run(tokens, lm.pa.Table.from_pylist([reply, reply | {"shard": 1}], schema)).to_pylist()
    assert added[0]["n_tokens"] == 1 and added[0]["score"] == pytest.approx(np.log10(1000.0 * 2 / 14) - np.log10(1001.0))
