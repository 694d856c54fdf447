"""Language-model scores from a sharded Elias-Fano n-gram trie.

The model is a bigram one with Dirichlet smoothing,

    p(w | v) = (c(v, w) + mu p(w)) / (c(v) + mu),   p(w) = (c(w) + 1) / (N + V + 1).

Every token is once a word and once the context of the next (the end of a text
is the context of its first word), so a text's score is the sum over its tokens
of log10(c(v, w) + mu p(w)) - log10(c(w) + mu): all that a token needs is kept
with its word. Words are dealt to shards, a frequent word's contexts to several;
each shard counts its training n-grams, builds its part of the trie in
memory-mapped levels, and answers what it is asked. A portion of texts asks once
for each distinct pair, so what moves per token stays the same however many
shards there are; the answers (a byte per pair) meet the portion's tokens again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from assay.llm.common import arrow_stage, stored, texts_of
from assay.llm.eliasfano import EliasFano, mapped

#: The end of a text; no word contains white space.
END = b"\n"
#: Steps of the quantised log10 probabilities per unit: one byte spans 0 to 10.5.
STEPS = 24
#: The code of a pair that training did not see.
UNSEEN = 255
#: Tokens that a task gathers, and tokens per shard.
TOKENS_AT_ONCE = 1 << 20
SHARD_TOKENS = 1_250_000
#: Look-ups that are answered side by side.
AT_ONCE = 1 << 18
TEXTS_AT_ONCE = 1 << 15
_WORD_BITS = 24
_NO_ID = -(1 << 63)


def words_of(text: str) -> list[bytes]:
    """Words with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def held_out(row_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Is the row kept from training? A null id hashes as the empty text."""
    return F.crc32(F.coalesce(row_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _portions(batches: Iterator[pa.RecordBatch]):
    """``(words, ids, documents)``: the distinct words of a portion of texts, the
    tokens as word numbers (0 is the end) and ``(place, held, tokens)`` of each
    part of a text. A very long text goes over several portions."""
    numbers: dict[bytes, int] = {END: 0}
    ids: list[np.ndarray] = []
    docs: list[tuple[int, bool, int]] = []
    before, held_tokens, place = 0, 0, 0

    def close():
        nonlocal numbers, ids, docs, held_tokens
        out = list(numbers), np.concatenate(ids), docs
        numbers, ids, docs, held_tokens = {END: 0}, [], [], 0
        return out

    for batch in batches:
        for t, held in zip(texts_of(batch.column("_text")), batch.column("_held").to_pylist()):
            words = words_of(t) + [END]
            for at in range(0, len(words), TOKENS_AT_ONCE):
                part = words[at : at + TOKENS_AT_ONCE]
                ids.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in part), np.int64, len(part)))
                docs.append((place, held, len(part)))
                held_tokens += len(part)
                if held_tokens >= TOKENS_AT_ONCE or len(docs) >= TEXTS_AT_ONCE:
                    # The context of a continued part is its last word so far.
                    yield before, *close()
                    before = xxhash.xxh3_64_intdigest(part[-1])
            place += 1
    if docs:
        yield before, *close()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def unigrams(rows: DataFrame, shards: int) -> DataFrame:
    """``shard, words, counts``: training counts of the words of each shard."""

    def count(batches):
        for _, words, ids, docs in _portions(batches):
            train = np.repeat([not d[1] for d in docs], [d[2] for d in docs])
            counts = np.bincount(ids[train], minlength=len(words))
            seen = np.flatnonzero(counts)
            hashes = _hashes([words[i] for i in seen])
            counts, shard = counts[seen], (hashes % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            parts = [order[a:b] for a, b in zip(cuts, cuts[1:])]
            some = [s for s in range(shards) if len(parts[s])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([hashes[parts[s]].tobytes() for s in some], pa.binary()), pa.array([counts[parts[s]].astype(np.uint32).tobytes() for s in some], pa.binary())],
                ["shard", "words", "counts"],
            )

    def add(table: pa.Table) -> pa.Table:
        words = np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint64)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32)
        unique, inverse = np.unique(words, return_inverse=True)
        total = np.bincount(inverse, counts).astype(np.int64)
        return pa.table({"shard": table.column("shard")[:1], "distinct": pa.array([len(unique)], pa.int64()), "tokens": pa.array([int(total.sum())], pa.int64()), "words": pa.array([unique.tobytes()], pa.binary()), "counts": pa.array([total.tobytes()], pa.binary())})

    counted = rows.mapInArrow(count, "shard int, words binary, counts binary")
    return counted.groupBy("shard").applyInArrow(add, "shard int, distinct long, tokens long, words binary, counts binary")


def _frequent(table: DataFrame, least: int) -> dict[int, int]:
    """Counts of the words with at least ``least`` training tokens; there are at
    most N / least of them."""

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = np.frombuffer(b"".join(batch.column("words").to_pylist()), np.uint64)
        counts = np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.int64)
        often = counts >= least
        return pa.RecordBatch.from_arrays([pa.array(words[often].view(np.int64)), pa.array(counts[often])], ["word", "n"])

    rows = arrow_stage(table.select("words", "counts"), "word long, n long", pick).collect()
    return {r["word"] % (1 << 64): r["n"] for r in rows}


_REQUESTS = "shard int, portion long, words binary, word_runs binary, contexts binary, counts binary"
_TOKENS = "portion long, shards int, places binary, ids binary, sizes binary, pairs binary"
_REPLIES = "shard int, portion long, known binary, word_runs binary, codes binary"


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in one byte each where all of them fit, else in four."""
    return counts.astype(np.uint8 if counts.max() < 1 << 8 else np.uint32)


def _joined(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


class _Dealer:
    """Numbers the distinct (word, context) pairs of a portion by their shard.

    The same portion is read twice: its pairs go to the shards, its tokens wait
    for the answers. Its name holds a digest of its words, so a portion that came
    out otherwise the second time would find no answers and fail.
    """

    def __init__(self, shards: int, frequent: dict[int, int], least: int):
        self.shards = shards
        self.often = np.array(sorted(frequent), np.uint64)
        self.pieces = np.array([1 + frequent[int(w)] // least for w in self.often], np.uint64)

    def portions(self, batches: Iterator[pa.RecordBatch]):
        """``(portion, hashes, word, context, shard cuts, pair of each token, docs)``."""
        base = TaskContext.get().partitionId() << 40
        for n, (before, words, ids, docs) in enumerate(_portions(batches)):
            hashes = _hashes(words)
            hashes = np.append(hashes, np.uint64(before) if before else hashes[0])
            name = xxhash.xxh3_64_intdigest(hashes.tobytes() + ids.tobytes(), base + n)
            context = np.r_[len(hashes) - 1, ids[:-1]]
            key, pair = np.unique(ids << _WORD_BITS | context, return_inverse=True)
            word, context = key >> _WORD_BITS, key & ((1 << _WORD_BITS) - 1)
            # The contexts of a frequent word go to as many places as its count asks for.
            pieces = np.ones(len(hashes), np.uint64)
            if len(self.often):
                at = np.minimum(np.searchsorted(self.often, hashes), len(self.often) - 1)
                pieces = np.where(self.often[at] == hashes, self.pieces[at], pieces)
            spot = _mix(hashes[word], hashes[context] % pieces[word])
            shard = (spot % np.uint64(self.shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
            yield name - (1 << 63), hashes, word[order], context[order], cuts, rank[pair], docs

    def requests(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each shard the words of its pairs, their contexts and training counts."""
        for portion, hashes, word, context, cuts, pair, docs in self.portions(batches):
            train = np.repeat([not d[1] for d in docs], [d[2] for d in docs])
            counts = np.bincount(pair[train], minlength=len(word))
            rows = []
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[s], cuts[s + 1])
                w, runs = np.unique(word[part], return_counts=True)
                rows.append((s, portion, hashes[w].tobytes(), runs.astype(np.uint32).tobytes(), hashes[context[part]].tobytes(), _narrow(counts[part]).tobytes()))
            yield _batch(rows, _REQUESTS)

    def tokens(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per portion: its texts and the pair number of every token, three bytes each."""
        base, names = TaskContext.get().partitionId() << 40, []

        def noted(source):
            for batch in source:
                names.extend(batch.column("_id").to_pylist())
                yield batch

        for portion, _, _, _, cuts, pair, docs in self.portions(noted(batches)):
            places = np.array([base + d[0] for d in docs], np.int64)
            ids = np.array([_NO_ID if names[d[0]] is None else names[d[0]] for d in docs], np.int64)
            sizes = np.array([d[2] for d in docs], np.uint32)
            planes = pair.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T
            yield _batch([(portion, int((np.diff(cuts) > 0).sum()), places.tobytes(), ids.tobytes(), sizes.tobytes(), planes.tobytes())], _TOKENS)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(values, kinds[k]) for values, (_, k) in zip(zip(*rows), fields)], [f[0] for f in fields])


class Trie:
    """Words and, for each, the contexts it was seen in, as Elias-Fano levels.

    ``contexts`` of one word are numbers that start again for every word; each
    word's are shifted past those of the word before, which keeps the level
    monotone, and a search inside a word's range is one for the shifted number.
    """

    def __init__(self, words: np.ndarray, word_of: np.ndarray, contexts: np.ndarray, weights: np.ndarray):
        """``words``: sorted hashes; the rest by (word, context)."""
        self.words = EliasFano(words)
        ends = np.searchsorted(word_of, np.arange(len(words)), side="right")
        self.pointers = EliasFano(np.r_[0, ends].astype(np.uint64) + np.arange(len(words) + 1, dtype=np.uint64))
        span = np.zeros(len(words), np.int64)
        np.maximum.at(span, word_of, contexts + 1)
        self.shift = np.cumsum(span) - span
        self.span = span
        self.level = EliasFano((contexts + self.shift[word_of]).astype(np.uint64))
        self.codes = mapped(np.clip(np.rint(STEPS * np.log10(np.maximum(weights, 1e-300))), 0, UNSEEN - 1).astype(np.uint8))

    def look_up(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Code of (word number, context): quantised log10 of its smoothed count, or ``UNSEEN``."""
        out = np.empty(len(word), np.uint8)
        for start in range(0, len(word), AT_ONCE):
            part = slice(start, start + AT_ONCE)
            out[part] = self._look_up(word[part], context[part])
        return out

    def _look_up(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        out = np.full(len(word), UNSEEN, np.uint8)
        first, last = (self.pointers.value(word + i).astype(np.int64) - word - i for i in (0, 1))
        inside = np.flatnonzero((context < self.span[word]) & (first < last))
        at = self.level.find(context[inside] + self.shift[word[inside]])
        hit = at >= 0
        out[inside[hit]] = self.codes[at[hit]]
        return out


def _answer(total: int, distinct: int, frequent: dict[int, int], mu: float):
    """Builds a shard's trie and answers its portions: training counts of the
    words, codes of the pairs, in the order they were asked in."""
    often = np.array(sorted(frequent), np.uint64)
    often_counts = np.array([frequent[int(w)] for w in often], np.int64)

    def run(table: pa.Table) -> pa.Table:
        asked, runs = _joined(table, "words", np.uint64), _joined(table, "word_runs", np.uint32)
        words, word_at = np.unique(asked, return_inverse=True)
        word = np.repeat(word_at, runs)
        contexts, context = np.unique(_joined(table, "contexts", np.uint64), return_inverse=True)
        counts = np.concatenate(
            [np.frombuffer(n, np.uint8 if 8 * len(n) == len(c) else np.uint32).astype(np.uint32) for n, c in zip(table.column("counts").to_pylist(), table.column("contexts").to_pylist())]
        )
        # All of a word's tokens are here, unless its contexts are dealt out.
        known = np.bincount(word, counts, len(words)).astype(np.int64)
        if len(often):
            at = np.minimum(np.searchsorted(often, words), len(often) - 1)
            known = np.where(often[at] == words, often_counts[at], known)
        pairs, pair = np.unique(word * len(contexts) + context, return_inverse=True)
        seen = np.bincount(pair, counts, len(pairs)).astype(np.int64)
        of_word, of_context = pairs // len(contexts), pairs % len(contexts)
        prior = mu * (known + 1) / (total + distinct + 1)
        kept = np.flatnonzero(seen)
        trie = Trie(words, of_word[kept], of_context[kept], seen[kept] + prior[of_word[kept]])
        codes = trie.look_up(trie.words.find(words)[of_word], of_context)[pair]

        def rows(values: np.ndarray, sizes: list[int]) -> pa.Array:
            return pa.array([x.tobytes() for x in np.split(values, np.cumsum(sizes)[:-1])], pa.binary())

        n_words, n_pairs = ([len(b) // 8 for b in table.column(c).to_pylist()] for c in ("words", "contexts"))
        return pa.table({"shard": table.column("shard"), "portion": table.column("portion"), "known": rows(known[word_at], n_words), "word_runs": table.column("word_runs"), "codes": rows(codes, n_pairs)})

    return run


def _add_up(total: int, distinct: int, mu: float):
    """Sums over the tokens of a portion's texts."""

    def run(tokens: pa.Table, replies: pa.Table) -> pa.Table:
        if tokens.num_rows != 1 or replies.num_rows != tokens.column("shards")[0].as_py():
            raise RuntimeError("the documents came out differently when they were read again")
        replies = replies.sort_by("shard")
        known = np.repeat(_joined(replies, "known", np.int64), _joined(replies, "word_runs", np.uint32))
        codes = _joined(replies, "codes", np.uint8)
        values = np.where(codes == UNSEEN, np.log10(mu * (known + 1) / (total + distinct + 1)), codes / STEPS) - np.log10(known + mu)
        place, name, sizes = _joined(tokens, "places", np.int64), _joined(tokens, "ids", np.int64), _joined(tokens, "sizes", np.uint32)
        planes = np.zeros((int(sizes.sum()), 4), np.uint8)
        planes[:, :3] = _joined(tokens, "pairs", np.uint8).reshape(3, -1).T
        pair, doc, n = planes.view("<u4").ravel(), np.repeat(np.arange(len(sizes)), sizes), len(sizes)
        known = known[pair]
        return pa.table({
            "place": place, "id": pa.array(name, mask=name == _NO_ID), "n_tokens": sizes.astype(np.int64), "n_known": np.bincount(doc, known > 0, n).astype(np.int64),
            "base": np.bincount(doc, np.log10(known + 1.0), n), "score": np.bincount(doc, values[pair], n),
        })

    return run


def score_texts(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2, mu: float = 1000.0,
    shard_tokens: int = SHARD_TOKENS, count_shards: int = 64,
) -> DataFrame:
    """``row_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from the rows whose id's crc32 modulo ``folds`` is not ``fold`` and
    scores all. A null text
    is empty and has the end as its only token; repeated rows count and are
    scored one by one; a null id is allowed; the id must be an integer. Without
    training rows nothing is known. An empty table gives no rows, other columns
    are not read. The model's probabilities are rounded to ``1 / STEPS`` in
    log10; words are told apart by 64-bit hashes. The rows are read more than
    once and must come in the same partitions and order, as those of a table do;
    if they do not, the job fails.
    """
    rows = docs.select(F.col(row_id).cast("long").alias("_id"), F.col(text).alias("_text"), held_out(F.col(row_id), folds, fold).alias("_held"))
    table = stored(unigrams(rows, count_shards), "unigrams")
    sums = table.agg(F.coalesce(F.sum("distinct"), F.lit(0)).alias("v"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()
    distinct, total = int(sums["v"]), int(sums["n"])
    shards = 1 + total // shard_tokens
    # A word with more than a quarter of a shard's tokens has its contexts dealt out; at most 4 x shards words.
    least = max(1, total // (4 * shards))
    frequent = _frequent(table, least)
    dealer = _Dealer(shards, frequent, least)
    replies = rows.mapInArrow(dealer.requests, _REQUESTS).groupBy("shard").applyInArrow(_answer(total, distinct, frequent, mu), _REPLIES)
    tokens = rows.mapInArrow(dealer.tokens, _TOKENS)
    parts = tokens.groupBy("portion").cogroup(replies.groupBy("portion")).applyInArrow(
        _add_up(total, distinct, mu), "place long, id long, n_tokens long, n_known long, base double, score double"
    )
    out = parts.groupBy("place").agg(F.max("id").alias("id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    return out.select(
        F.col("id").alias(row_id), held_out(F.col("id"), folds, fold).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"), "score",
    )
