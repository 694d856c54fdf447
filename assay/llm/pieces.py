"""SentencePiece encoding and decoding as a max-plus scan over chunks.

The vocabulary is a BPE one: its encoding of a text is the only sequence of
pieces in which every two neighbours stay apart when they are encoded alone.
That makes encoding a path problem. A state is the last piece and where it
ends; a step to the next piece weighs -1 where the two pieces may stand side by
side and minus infinity where they may not. A chunk of a giant document does
not know the state it starts in, so it yields the max-plus matrix from every
state at its left border to every state at its right border. Products of the
matrices are associative; they fix the state at every border (and how many
pieces lie before it), after which each chunk finds its own pieces alone.

Where two neighbouring characters occur together in no piece, a piece must end
there whatever came before. Chunks use those places to keep matrices small, and
the words between them are searched side by side (``wordsearch.py``), some
texts at a time and with nothing remembered.
"""

from __future__ import annotations

import zlib
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from assay.llm.common import arrow_stage, slices, stored, texts_of
from assay.llm.wordsearch import WordSearch

SPACE = "▁"
NOWHERE = float("-inf")
#: Pairs that a task remembers.
KNOWN = 50_000
#: Bytes of text, or of ids, that a task works on at a time.
AT_ONCE = 1 << 20
State = tuple[int, str]
START: State = (0, "")


class PieceModel:
    """Pieces and ranks of a model file, with the rule which pieces may be neighbours."""

    def __init__(self, path: str):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_id, self.id_of = bytes_and_pieces(library)
        self.unknown = library.unk_id()
        self.score = {p: library.get_score(i) for p, i in self.id_of.items()}
        place = {score: n for n, score in enumerate(sorted({s for p, s in self.score.items() if len(p) > 1}, reverse=True))}
        #: Order in which pieces come to be; single characters are there from the start.
        self.rank = {p: (place[s] if len(p) > 1 else -1) for p, s in self.score.items()}
        self.longest = max(map(len, self.id_of), default=1)
        self.beginnings = {p[:n] for p in self.id_of for n in range(1, len(p) + 1)}
        self.inside = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        self.surface = surface_of(self.byte_id, self.id_of)
        #: May a text be cut in front of every run of spaces?
        self.space_cuts = not any(p[1] == SPACE and p[0] != SPACE for p in self.inside)
        self._halves: dict[str, tuple[str, str]] = {}
        self._beside: dict[tuple[str, str], bool] = {}

    @cached_property
    def words(self) -> WordSearch:
        return WordSearch(self)

    # -- pieces side by side

    def merge(self, text: str) -> list[str]:
        """Plain merging: best score first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score.get(a + b, NOWHERE), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == NOWHERE:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that the piece is made of; none for a character."""
        if len(piece) < 2:
            return None
        if piece not in self._halves:
            parts = list(piece)
            while len(parts) > 2:
                score, back = max(((self.score.get(a + b, NOWHERE), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
                if score == NOWHERE:
                    break
                parts[-back : -back + 2] = [parts[-back] + parts[-back + 1]]
            self._halves[piece] = (parts[0], parts[1]) if len(parts) == 2 else ("", "")
        return self._halves[piece]

    def beside(self, left: str, right: str) -> bool:
        """Do ``left`` and ``right`` stay apart when encoded together?"""
        if not left or left not in self.rank or right not in self.rank:
            return right not in self.rank or self.halves(right) != ("", "")
        key = (left, right)
        if key not in self._beside:
            if len(self._beside) > KNOWN:
                self._beside.clear()
            self._beside[key] = self._apart(left, right)
        return self._beside[key]

    def _apart(self, left: str, right: str) -> bool:
        if self.halves(left) == ("", "") or self.halves(right) == ("", ""):
            return False
        if left[-1] == SPACE or left == right:
            # Runs of one character hold pieces of equal rank; merge them for real.
            return self.merge(left + right) == [left, right]
        limit = 1 << 60
        while True:
            if self.rank.get(left + right, 1 << 61) < limit:
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            # Undo the later of the two pieces: what it was made of met its neighbour before.
            if a > b:
                limit, left = a, self.halves(left)[1]
            else:
                limit, right = b + 1, self.halves(right)[0]

    # -- paths

    def starting(self, x: str, at: int, stop: int):
        """Pieces that start at ``at`` and end by ``stop``; an unknown character stands alone."""
        if x[at] not in self.id_of:
            yield x[at]
        for n in range(1, min(self.longest, stop - at) + 1):
            piece = x[at : at + n]
            if piece not in self.beginnings:
                return
            if piece in self.id_of:
                yield piece

    def safe(self, x: str, at: int) -> bool:
        return x[at - 1 : at + 1] not in self.inside

    def path(self, x: str, begin: int, end: int, before: str, last: str | None = None) -> list[str]:
        """The pieces from ``begin`` to exactly ``end`` after the piece
        ``before``; ``last``, if given, is the final one."""
        came: dict[int, dict[str, tuple[int, str] | None]] = {begin: {before: None}}
        for at in range(begin, end):
            here = came.get(at)
            if here:
                for piece in self.starting(x, at, end):
                    for previous in here:
                        if self.beside(previous, piece):
                            came.setdefault(at + len(piece), {}).setdefault(piece, (at, previous))
                            break
        ends = came.get(end, {})
        at, piece = end, last if last is not None else next(iter(ends), None)
        if piece is None or (piece not in ends and begin != end):
            raise ValueError("no path between the given states")
        out = []
        while at > begin:
            out.append(piece)
            at, piece = came[at][piece]
        return out[::-1]

    def ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if p in self.id_of:
                out.append(self.id_of[p])
            elif self.byte_id:
                out.extend(self.byte_id[b] for b in p.encode("utf-8", "replace"))
            else:
                out.append(self.unknown)
        return out

    def search(self, x: str) -> list[str]:
        """The path through a short text, depth first and longest piece first;
        as there is only one path, the first that reaches the end is it."""
        out, at, before, dead, stop, known = [], 0, "", set(), len(x), self._beside
        while at < stop:
            for piece in reversed(list(self.starting(x, at, stop))):
                if at + len(piece) in dead:
                    continue
                fits = known.get((before, piece))
                if fits if fits is not None else self.beside(before, piece):
                    out.append(piece)
                    at, before = at + len(piece), piece
                    break
            else:
                if not out:
                    raise ValueError("no path through the text")
                dead.add(at)
                at -= len(out.pop())
                before = out[-1] if out else ""
        return out

    def encode_all(self, texts: list[str]) -> pa.BinaryArray:
        """Ids of normalised texts between safe borders."""
        return self.words.encode(texts)

    def encode_whole(self, x: str) -> bytes:
        """Ids of a normalised text between safe borders."""
        return self.encode_all([x])[0].as_py()

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.surface.__getitem__, ids.tolist()))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")

    # -- chunks

    def entries(self, x: str, begin: int) -> list[State]:
        """States at the border ``begin``: (characters past it, last piece)."""
        if begin == 0:
            return [START]
        out = []
        for start in range(max(0, begin - self.longest), begin):
            for piece in self.starting(x, start, len(x)):
                if start + len(piece) >= begin:
                    out.append((start + len(piece) - begin, piece))
        return sorted(set(out))

    def transfer(self, x: str, begin: int, end: int, entries: list[State], middle: int | None = None) -> tuple[list[State], np.ndarray]:
        """Exit states and the max-plus matrix from ``entries``: minus the number
        of ids that start in ``[begin, end)``, or minus infinity. ``middle``, if
        known, is the number of ids between the safe places."""
        nodes: dict[int, dict[str, np.ndarray]] = {}
        for n, (past, piece) in enumerate(entries):
            vector = np.full(len(entries), NOWHERE)
            vector[n] = 0.0
            nodes.setdefault(begin + past, {})[piece] = vector
        first, last = self.safe_places(x, begin, end)
        if first < last:
            # All states agree from a safe place on.
            self._advance(x, nodes, begin, first)
            reached = np.maximum.reduce(list(nodes.pop(first).values()))
            if middle is None:
                middle = len(self.encode_whole(x[first:last])) // 4
            nodes, begin = {last: {"": reached - middle}}, last
        self._advance(x, nodes, begin, end)
        exits = sorted((p - end, piece) for p, row in nodes.items() for piece in row)
        matrix = np.array([nodes[end + past][piece] for past, piece in exits]).reshape(len(exits), len(entries)).T
        return exits, matrix

    def safe_places(self, x: str, begin: int, end: int) -> tuple[int, int]:
        """The first and the last place in ``[begin, end)`` where a run of spaces
        starts and a piece must end; ``(end, begin)`` if there is none."""
        if not self.space_cuts:
            return end, begin
        first = x.find(SPACE, begin, end)
        while first > 0 and x[first - 1] == SPACE:
            first = x.find(SPACE, first + 1, end)
        last = x.rfind(SPACE, begin, end)
        while last > begin and x[last - 1] == SPACE:
            last -= 1
        return (end, begin) if first < 0 or last < 0 or (last == begin and last > 0 and x[last - 1] == SPACE) else (first, last)

    def _advance(self, x: str, nodes: dict[int, dict[str, np.ndarray]], begin: int, end: int) -> None:
        """Carry the states at places before ``end`` to those at or past it."""
        for at in range(begin, end):
            here = nodes.pop(at, None)
            if here:
                for piece in self.starting(x, at, len(x)):
                    into = None
                    for previous, vector in here.items():
                        if self.beside(previous, piece):
                            into = vector if into is None else np.maximum(into, vector)
                    if into is not None:
                        nodes.setdefault(at + len(piece), {})[piece] = into - (1.0 if piece in self.id_of else len(piece.encode("utf-8", "replace")))

    def middle(self, x: str, begin: int, end: int) -> str:
        """The text between the first and the last safe place, empty if there is none."""
        first, last = self.safe_places(x, begin, end)
        return x[first:last] if first < last else ""

    def between(self, x: str, begin: int, end: int, entry: State, leave: State, middle: bytes | None = None) -> list[int]:
        """Ids of the pieces that start in ``[begin, end)``, given both border
        states and, if known, the ids of the ``middle`` after the entry."""
        a, b = begin + entry[0], end + leave[0]
        if a >= b:
            return []
        first, last = self.safe_places(x, a, end)
        if first >= last:
            return self.ids(self.path(x, a, b, entry[1], leave[1]))
        head = self.ids(self.path(x, a, first, entry[1])) if first > a else []
        if middle is None:
            middle = self.encode_whole(x[first:last])
        return head + np.frombuffer(middle, "<u4").tolist() + self.ids(self.path(x, last, b, "", leave[1]))


def bytes_and_pieces(library: sentencepiece.SentencePieceProcessor) -> tuple[dict[int, int], dict[str, int]]:
    """Ids of the single bytes and of the plain pieces."""
    ids = range(library.get_piece_size())
    of_bytes = {int(library.id_to_piece(i)[3:5], 16): i for i in ids if library.is_byte(i)}
    plain = [i for i in ids if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
    return of_bytes, {library.id_to_piece(i): i for i in plain}


def surface_of(of_bytes: dict[int, int], of_pieces: dict[str, int]) -> dict[int, bytes]:
    """What each id stands for in a text."""
    return {i: p.replace(SPACE, " ").encode() for p, i in of_pieces.items()} | {i: bytes([b]) for b, i in of_bytes.items()}


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; associative."""
    return np.max(a[:, :, None] + b[None, :, :], axis=1)


def settle(chunks: list[tuple[list[State], list[State], np.ndarray]]) -> list[tuple[State, State, int]]:
    """``(entry, exit, pieces before)`` of each chunk of a document, from the
    chunks' entries, exits and matrices in order."""
    ahead = [np.zeros((1, 1))]
    for n, (_, exits, matrix) in enumerate(chunks):
        done = combine(ahead[-1], matrix)
        if n + 1 < len(chunks):
            at = {s: i for i, s in enumerate(exits)}
            done = np.array([[done[0, at[s]] if s in at else NOWHERE for s in chunks[n + 1][0]]])
        ahead.append(done)
    out, leave = [], None
    for n in reversed(range(len(chunks))):
        entries, exits, matrix = chunks[n]
        if leave is None:
            ends = [i for i, s in enumerate(exits) if s[0] == 0]
            leave = exits[max(ends, key=lambda i: ahead[n + 1][0, i])]
        column = ahead[n][0] + matrix[:, exits.index(leave)]
        best = int(np.argmax(column))
        if column[best] == NOWHERE:
            raise ValueError("no path through the document")
        out.append((entries[best], leave, int(-ahead[n][0, best])))
        leave = entries[best]
    return out[::-1]


def normalise(text: str) -> str:
    """What the model file's identity normaliser does: mark spaces, put one in front."""
    return SPACE + text.replace(" ", SPACE) if text else ""


@lru_cache(maxsize=1)
def model(path: str) -> PieceModel:
    return PieceModel(path)


@lru_cache(maxsize=1)
def surfaces(path: str) -> pa.BinaryArray:
    """What each id of a model file stands for, null for none; less to keep than the model."""
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    found = surface_of(*bytes_and_pieces(library))
    return pa.array([found.get(i) for i in range(library.get_piece_size())], pa.binary())


def decode_all(ids: list[bytes], path: str) -> list[str]:
    """The texts of rows of ids."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    found = surfaces(path).take(pa.array(flat))
    if found.null_count:
        raise ValueError("an id that stands for nothing")
    data, ends = found.buffers()[2], np.frombuffer(found.buffers()[1], np.int32)
    bounds = ends[np.concatenate([[0], np.cumsum([len(b) // 4 for b in ids], dtype=np.int64)])].tolist() if len(flat) else [0] * (len(ids) + 1)
    texts = [data[a:b].to_pybytes() if b > a else b"" for a, b in zip(bounds, bounds[1:])]
    return [(t[1:] if t[:1] == b" " else t).decode("utf-8", "replace") for t in texts]


_CHUNK = "uid long, n long, whole boolean, x string, begin int, stop int"


def _pack_states(states: list[State]) -> list[str]:
    return [f"{past}:{piece}" for past, piece in states]


def _unpack_states(states) -> list[State]:
    return [(int(s.partition(":")[0]), s.partition(":")[2]) for s in states]


def encode(docs: DataFrame, model_file: str, row_id: str = "doc_id", text: str = "text", chunk_chars: int = 1 << 15) -> DataFrame:
    """``row_id`` and ``ids`` (little-endian 32 bits each) of every row.

    Equal to the model file's own library. Texts longer than ``chunk_chars``
    are cut into chunks that different tasks encode; shorter ones are a chunk of
    their own. A null or empty text has no ids. Repeated rows are encoded one by
    one, other columns are not read, an empty table gives no rows.
    """
    rows = docs.select(F.col(row_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    id_type = docs.schema[row_id].dataType.simpleString()
    giant = F.char_length("_text") > chunk_chars

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("_id"), model(model_file).encode_all([normalise(t) for t in texts_of(batch.column("_text"))])], ["_id", "ids"])

    short = arrow_stage(rows.where(~giant), f"_id {id_type}, ids binary", whole, "_text", AT_ONCE)
    side = max(map(len, bytes_and_pieces(sentencepiece.SentencePieceProcessor(model_file=model_file))[1]), default=1)

    def cut(batches):
        base, seen = TaskContext.get().partitionId() << 40, 0
        for batch in slices(batches, "_text", AT_ONCE):
            for name, t in zip(batch.column("_id").to_pylist(), texts_of(batch.column("_text"))):
                x = normalise(t)
                starts = range(0, len(x), chunk_chars)
                parts = [(max(0, b - side), b, min(len(x), b + chunk_chars)) for b in starts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(parts), batch.schema.field("_id").type), pa.array([base + seen] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()),
                        pa.array([x[lo : e + side] for lo, _, e in parts]), pa.array([b - lo for lo, b, _ in parts], pa.int32()), pa.array([e - lo for lo, _, e in parts], pa.int32()),
                    ],
                    ["_id", "uid", "n", "x", "begin", "stop"],
                )
                seen += 1

    chunks = stored(rows.where(giant).mapInArrow(cut, f"_id {id_type}, uid long, n long, x string, begin int, stop int").repartition("uid", "n"), "chunks")

    def matrices(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, out = model(model_file), []
        chunk = list(zip(*[batch.column(c).to_pylist() for c in ("n", "x", "begin", "stop")]))
        counts = pc.binary_length(m.encode_all([m.middle(x, begin, stop) for _, x, begin, stop in chunk])).to_pylist()
        for (n, x, begin, stop), size in zip(chunk, counts):
            entries = m.entries(x, begin) if n else [START]
            exits, matrix = m.transfer(x, begin, stop, entries, size // 4)
            out.append((_pack_states(entries), _pack_states(exits), matrix.ravel().tolist()))
        strings = pa.list_(pa.string())
        return pa.RecordBatch.from_arrays(
            [batch.column("uid"), batch.column("n"), pa.array([o[0] for o in out], strings), pa.array([o[1] for o in out], strings), pa.array([o[2] for o in out], pa.list_(pa.float64()))],
            ["uid", "n", "entries", "exits", "matrix"],
        )

    borders = arrow_stage(chunks.select("uid", "n", "x", "begin", "stop"), "uid long, n long, entries array<string>, exits array<string>, matrix array<double>", matrices, "x", AT_ONCE)

    def fix(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        parts = []
        for entries, exits, matrix in zip(rows["entries"], rows["exits"], rows["matrix"]):
            parts.append((_unpack_states(entries), _unpack_states(exits), np.asarray(matrix).reshape(len(entries), len(exits))))
        found = settle(parts)
        return pd.DataFrame({"uid": rows["uid"].to_numpy(), "n": rows["n"].to_numpy(), "entry": _pack_states([f[0] for f in found]), "leave": _pack_states([f[1] for f in found])})

    # One small row per chunk: a group holds a document's borders, not its text.
    fixed = borders.groupBy("uid").applyInPandas(fix, "uid long, n long, entry string, leave string")

    def back(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, out = model(model_file), []
        x, begin, stop = (batch.column(c).to_pylist() for c in ("x", "begin", "stop"))
        entry, leave = (_unpack_states(batch.column(c).to_pylist()) for c in ("entry", "leave"))
        middles = m.encode_all([m.middle(t, b + e[0], s) for t, b, s, e in zip(x, begin, stop, entry)]).to_pylist()
        for row in zip(x, begin, stop, entry, leave, middles):
            out.append(np.array(m.between(*row), "<u4").tobytes())
        return pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("uid"), batch.column("n"), pa.array(out, pa.binary())], ["_id", "uid", "n", "part"])

    traced = arrow_stage(chunks.join(fixed, ["uid", "n"]), f"_id {id_type}, uid long, n long, part binary", back_columns(back), "x", AT_ONCE)
    long = traced.groupBy("uid").agg(F.first("_id").alias("_id"), F.array_sort(F.collect_list(F.struct("n", "part"))).alias("parts")).select(
        "_id", F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["part"])).alias("ids")
    )
    return short.unionByName(long).select(F.col("_id").alias(row_id), "ids")


def back_columns(step):
    """Name the columns a step needs, whatever order the join gives them in."""
    return lambda batch: step(batch.select(["_id", "uid", "n", "x", "begin", "stop", "entry", "leave"]))


def decode(encoded: DataFrame, model_file: str, row_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``row_id`` and ``text``. Spaces that the text wrote as the mark itself come
    back as spaces; null ids give an empty text."""
    rows = encoded.select(F.col(row_id).alias("_id"), F.coalesce(F.col(ids), F.lit(b"")).alias("_ids"))
    id_type = encoded.schema[row_id].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(decode_all(batch.column("_ids").to_pylist(), model_file))], ["_id", "text"])

    return arrow_stage(rows, f"_id {id_type}, text string", step, "_ids", AT_ONCE).withColumnRenamed("_id", row_id)


def with_digest(encoded: DataFrame, model_file: str, row_id: str = "doc_id") -> DataFrame:
    """``row_id, n_pieces, ids_crc32, decoded_crc32``: the digest columns of a
    row's ids and of the text they decode to."""
    id_type = encoded.schema[row_id].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = batch.column("ids").to_pylist()
        texts = [t.encode() for t in decode_all(data, model_file)]
        columns = [batch.column("_id"), pa.array([len(b) // 4 for b in data], pa.int64()), pa.array([zlib.crc32(b) for b in data], pa.int64()), pa.array([zlib.crc32(t) for t in texts], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["_id", "n_pieces", "ids_crc32", "decoded_crc32"])

    rows = encoded.select(F.col(row_id).alias("_id"), "ids")
    return arrow_stage(rows, f"_id {id_type}, n_pieces long, ids_crc32 long, decoded_crc32 long", step, "ids", AT_ONCE).withColumnRenamed("_id", row_id)
