"""Encoding and decoding with a SentencePiece model, best and N-best segmentations.

A text is a lattice of pieces. The forward Viterbi scores of its nodes are the exact best scores of what lies before
them, so a backward A-star search with them as heuristic yields segmentations in order, the best first, and never
expands a node in vain. Pieces hold spaces at their front only and no line breaks, so a text's lattice falls apart at
those places into chunks; the best segmentation is that of its chunks, and the N best differ from it only in the
``N - 1`` chunks of which the second best loses least. Chunks repeat, so their results are cached in a bounded table.

The model's file is read on the driver; the tasks get its vocabulary, whose size is that of the model, not the data.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
#: Chunks, and piece ids of chunks, that a task remembers before it starts anew.
CACHE, CACHED_IDS = 250_000, 4_000_000
#: Rows of which the results are held at a time; they are several times as large as the texts.
ROWS = 500
#: Piece ids of the N best ways of chunks that a task remembers.
WAYS_IDS = 300_000
_CHUNK = re.compile(" +[^ \n]*|[^ \n]+|\n")

Vocabulary = dict[str, tuple[int, float]]


@lru_cache(4)
def load(path: str = MODEL) -> tuple[Vocabulary, tuple[int, ...], list[bytes]]:
    """Pieces with id and score, the ids of the 256 byte pieces, and what each id decodes to."""
    from sentencepiece import sentencepiece_model_pb2 as model

    proto = model.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    pieces: Vocabulary = {}
    by_byte, text = [0] * 256, []
    for i, p in enumerate(proto.pieces):
        text.append(b"")
        if p.type == 6:
            by_byte[int(p.piece[1:-1], 16)] = i
            text[i] = bytes([int(p.piece[1:-1], 16)])
        elif p.type in (1, 4):
            piece = p.piece.replace("\u2581", " ")  # the model's mark for a space
            pieces[piece] = (i, p.score)
            text[i] = piece.encode()
    return pieces, tuple(by_byte), text


class _Known(dict):
    """Chunk to its number; a chunk that is looked up for the first time is solved."""

    def __init__(self, solve):
        self.solve = solve

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = self.solve(chunk)
        return n


class Lattice(NamedTuple):
    """The forward pass over a chunk: the best score up to each node, its pieces, and the piece it comes by (-1: bytes).

    ``second`` has the score by each node's second-best edge, ``ties`` how many pieces more that edge makes where it is as
    good as the best.
    """

    score: list[float]
    count: list[int]
    piece: list[int]
    second: list[float]
    ties: dict[int, int]


_NONE = -1e300
#: A way: minus its score, its pieces, its forks from the best way as a key that sorts, and the forks themselves.
Way = tuple[float, int, tuple, tuple]
_END = ((1, 0, 0),)


def fork_key(j: int, i: int, best: int) -> tuple[int, int, int]:
    """Place of a way that forks at node ``j`` to node ``i``, seen from the end; the way that goes on is ``_END``.

    Ways are compared at the first edge from the end in which they differ, and the longer piece comes first. So a fork
    to a longer piece comes before the way without it, the sooner the nearer the end; one to a shorter piece after it.
    """
    return (0, -j, i) if i < best else (2, j, i)


@lru_cache(1)
def _finder(pieces: tuple[tuple[str, tuple[int, float]], ...]) -> ahocorasick.Automaton:
    """Finds all pieces in a text in one pass: for each end, the longest first. Of the model's size; one per process."""
    found = ahocorasick.Automaton()
    for piece, (i, score) in pieces:
        found.add_word(piece, (i, score, len(piece), 1))
    found.make_automaton()
    return found


class Segmenter:
    """Segmentations of texts under one vocabulary. Scores add up; a character without a piece costs ``unknown``.

    One order holds everywhere, for the best and for the N best: the greater score comes first, of equals that of fewer
    pieces, then that whose piece is longer where the two first differ, read from the end.

    What is known of chunks lies in arrays, so that a text's result is gathered from them by its chunks' numbers.
    """

    def __init__(self, pieces: Vocabulary, by_byte: tuple[int, ...], text: list[bytes]):
        self.pieces, self.by_byte, self.text = pieces, by_byte, text
        self.longest = max(map(len, pieces))
        # pieces of spaces alone have scores of minus a thousand million: no measure for a lost character
        self.unknown = min((s for _, s in pieces.values() if s > -1e8), default=0.0) - 10
        #: Characters that are pieces, and the characters of each id (the last, for -1: of a character by its bytes).
        self.single = {x for x in pieces if len(x) == 1}
        self.length = [0] * len(text) + [1]
        for piece, (i, _) in pieces.items():
            self.length[i] = len(piece)
        self.find = _finder(tuple(pieces.items())).iter
        self.forget()

    def forget(self) -> None:
        self.known = _Known(self._add)
        self.ways: dict[tuple[str, int], list] = {}
        self.ways_ids = 0
        # of each chunk: where its ids start, how many they are, score, loss of the second way, whether it decodes
        self.start, self.size, self.ids = array("q"), array("q"), array("i")
        self.score, self.lost, self.same = array("d"), array("d"), array("b")
        self.ties: dict[int, tuple[int, bool]] = {}
        self.last: tuple[str, Lattice | None] = ("", None)

    def _add(self, chunk: str) -> int:
        ids, score, lost = self.solve(chunk)
        n, text = len(self.start), self.text
        self.start.append(len(self.ids))
        self.size.append(len(ids))
        self.score.append(score)
        self.lost.append(lost)
        self.same.append(b"".join([text[i] for i in ids]) == chunk.encode("utf-8", "surrogatepass"))
        self.ids.extend(ids)
        return n

    def edges(self, chunk: str, j: int) -> list[tuple[int, int, int, float]]:
        """(start, piece id or -1 for bytes, pieces, score) of the edges that end at node ``j``, the longest first."""
        get, out = self.pieces.get, []
        for i in range(max(0, j - self.longest), j):
            p = get(chunk[i:j])
            if p is not None:
                out.append((i, p[0], 1, p[1]))
        if not out or out[-1][0] != j - 1:
            out.append((j - 1, -1, len(chunk[j - 1].encode("utf-8", "surrogatepass")), self.unknown))
        return out

    def _all_edges(self, chunk: str) -> Iterator[tuple[int, tuple[int, float, int, int]]]:
        """(end - 1, (piece, score, length, pieces)) of all edges, those of characters without a piece too."""
        found = self.find(chunk)
        now = next(found, None)
        for k, c in enumerate(chunk):
            while now and now[0] == k:
                yield now
                now = next(found, None)
            if c not in self.single:
                yield k, (-1, self.unknown, 1, len(c.encode("utf-8", "surrogatepass")))

    def forward(self, chunk: str) -> Lattice:
        """Viterbi over the nodes in turn; the edges into a node come by rising start, the longest piece first."""
        n, ties = len(chunk), {}
        score, count, piece, second = [_NONE] * (n + 1), [0] * (n + 1), [-1] * (n + 1), [_NONE] * (n + 1)
        score[0] = 0.0
        edges = self.find(chunk) if self.single.issuperset(chunk) else self._all_edges(chunk)
        for k, (p, s, size, pieces) in edges:
            j = k + 1
            i = j - size
            v, old = score[i] + s, score[j]
            if v > old:
                second[j] = old
                score[j] = v
                count[j] = count[i] + pieces
                piece[j] = p
            elif v >= second[j]:
                if v == old:
                    self._tied(ties, second[j] == old, count, piece, j, p, count[i] + pieces)
                second[j] = v
        return Lattice(score, count, piece, second, ties)

    @staticmethod
    def _tied(ties: dict[int, int], again: bool, count: list[int], piece: list[int], j: int, p: int, pieces: int) -> None:
        """Takes in an edge into node ``j`` that is as good as the best so far; ``again``: as others were already."""
        more = pieces - count[j]
        ties[j] = min(abs(more), ties[j] - min(0, more)) if again else abs(more)
        if more < 0:
            count[j], piece[j] = pieces, p

    def _walk(self, chunk: str, piece: list[int], forks: tuple) -> list[int]:
        """Ids along a way: back pointers from the end, but for its forks (node, start, piece)."""
        ids: list[int] = []
        j, at, length = len(chunk), {f[0]: f[2] for f in forks}, self.length
        while j:
            p = at.get(j, piece[j]) if at else piece[j]
            if p >= 0:
                ids.append(p)
            else:
                ids += [self.by_byte[x] for x in reversed(chunk[j - 1].encode("utf-8", "surrogatepass"))]
            j -= length[p]
        ids.reverse()
        return ids

    def solve(self, chunk: str) -> tuple[list[int], float, float]:
        """Ids and score of the best way, and what the second best loses (infinite if there is none).

        Seen from the end, the second best leaves the best way at one of its nodes and goes on by the best way from there.
        """
        lattice = self.forward(chunk)
        self.last = (chunk, lattice) if len(chunk) > 1000 else ("", None)
        score, piece, second, length = lattice.score, lattice.piece, lattice.second, self.length
        lost, j = -_NONE, len(chunk)
        while j:
            if score[j] - second[j] < lost:
                lost = score[j] - second[j]
            j -= length[piece[j]]
        return self._walk(chunk, piece, ()), score[-1], lost if lost < 1e200 else float("inf")

    def _forks(self, chunk: str, lattice: Lattice, j: int) -> list[tuple[float, int, int, int]]:
        """(loss, further pieces, start, piece) of the edges into node ``j`` other than the best, the least first."""
        score, count, best = lattice.score, lattice.count, lattice.piece[j]
        return sorted(
            (score[j] - (score[i] + s), count[i] + n - count[j], i, p) for i, p, n, s in self.edges(chunk, j) if p != best
        )

    def chunk_ways(self, chunk: str, n: int) -> list[tuple[float, list[int], tuple]]:
        """The ``n`` best as (score, ids, key that places them by their pieces): backward A-star, with the forward scores as exact heuristic.

        A partial way from the end stands for the best whole way that it can become, and its key is that way's. As the
        heuristic is exact, what is popped next is the popped way's own extension along the back pointers until it is
        whole, so that walk is one loop, in which every other edge becomes a new entry. An entry is its forks, not its
        edges. Different entries become different ways, so that only the best ``n`` less those found are held:
        ``n`` walks and ``n`` entries, whatever the length and the ties.
        """
        lattice = self.last[1] if self.last[0] == chunk and self.last[1] else self.forward(chunk)
        score, piece, second, ties, length = lattice.score, lattice.piece, lattice.second, lattice.ties, self.length
        known: dict[int, list] = {}
        front: list[Way] = [(-score[-1], lattice.count[-1], _END, ())]
        out: list[Way] = []
        while front and len(out) < n:
            way = front.pop(0)
            out.append(way)
            room = n - len(out)
            if not room:
                break
            cost, count, key, forks = way
            j = forks[-1][1] if forks else len(chunk)
            # what a fork must beat: the last of the entries, once there are enough of them
            most = front[-1][0] if len(front) == room else -_NONE
            while j:
                loss, i = score[j] - second[j], j - length[piece[j]]
                if cost + loss < most or cost + loss == most and (loss or count + ties[j] <= front[-1][1]):
                    if j not in known:
                        known[j] = self._forks(chunk, lattice, j)
                    for loss, more, at, p in known[j]:
                        entry = (cost + loss, count + more, key[:-1] + (fork_key(j, at, i),) + _END, (*forks, (j, at, p)))
                        if len(front) == room:
                            if entry > front[-1]:
                                break
                            del front[-1]
                        insort(front, entry)
                    most = front[-1][0] if len(front) == room else -_NONE
                j = i
        return [(-cost, self._walk(chunk, piece, forks), key) for cost, _, key, forks in out]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """A text's chunks, with the space that the model puts in front."""
        return _CHUNK.findall(" " + text) if text else []

    def _ways(self, chunk: str, n: int) -> list[tuple[float, list[int], tuple]]:
        found = self.ways.get((chunk, n))
        if found is None:
            found = self.chunk_ways(chunk, n)
            self.ways_ids += sum(len(w[1]) for w in found)
            if self.ways_ids > WAYS_IDS:
                self.ways.clear()
                self.ways_ids = sum(len(w[1]) for w in found)
            self.ways[chunk, n] = found
        return found

    def _tie(self, chunk: str, number: int, n: int) -> tuple[int, bool]:
        """How many pieces a chunk's second way has more, and whether its pieces alone would put it before the best."""
        if number not in self.ties:
            best, second = self._ways(chunk, n)[:2]
            self.ties[number] = (len(second[1]) - len(best[1]), second[2] < best[2])
        return self.ties[number]

    def _open(self, chunks: list[str], at: np.ndarray, n: int) -> list[int]:
        """The ``n - 1`` chunks whose second way makes the best second ways of the text, in the order of the text."""
        lost = np.frombuffer(self.lost)[at]
        if len(lost) < n:
            return np.flatnonzero(lost < np.inf).tolist()
        most = np.partition(lost, n - 2)[n - 2]
        if most == np.inf:
            return np.flatnonzero(lost < np.inf).tolist()
        sure, even = np.flatnonzero(lost < most).tolist(), np.flatnonzero(lost == most).tolist()
        room = n - 1 - len(sure)
        if len(even) > room:

            def place(k: int) -> tuple:
                more, late = self._tie(chunks[k], int(at[k]), n)
                return more, not late, -k if late else k

            even = sorted(even, key=place)[:room]
        return sorted(sure + even)

    def encode(self, text: str, n: int = 1) -> tuple[np.ndarray, list[tuple[float, np.ndarray]], bool]:
        """Ids of the best segmentation; the ``n`` best as (score, ids), the best first; and whether the ids decode
        to the text: decoding joins what the ids stand for, so each chunk is tried once."""
        if len(self.start) > CACHE or len(self.ids) > CACHED_IDS:
            self.forget()
        chunks = self.chunks(text)
        if not chunks:
            none = np.zeros(0, np.int32)
            return none, [(0.0, none)], True
        at = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        # the views must be gone before the arrays grow again
        size, start = (np.frombuffer(x, np.int64)[at] for x in (self.size, self.start))
        ends = np.cumsum(size)
        total = int(ends[-1])
        ids = np.frombuffer(self.ids, np.int32)[np.repeat(start - ends + size, size) + np.arange(total)]
        score = float(np.frombuffer(self.score)[at].sum())
        same = bool(np.frombuffer(self.same, np.int8)[at].all()) and "".join(chunks) == " " + text
        if n <= 1:
            self.last = ("", None)
            return ids, [(score, ids)], same
        open_ = self._open(chunks, at, n)
        # chunk by chunk, only the n best of what went before can go on; a chunk's ways come in their order, so of equal
        # scores and sizes the numbers of the ways, the last chunk's first, are the order
        ways: list[tuple[float, int, tuple[int, ...]]] = [(-score, total, ())]
        of = {k: self._ways(chunks[k], n) for k in open_}
        order = {k: sorted(range(len(of[k])), key=lambda w, k=k: of[k][w][2]) for k in open_}
        for k in open_:
            base, length = self.score[int(at[k])], int(size[k])
            ways = sorted(
                (t - of[k][w][0] + base, z + len(of[k][w][1]) - length, (place, *way))
                for t, z, way in ways
                for place, w in enumerate(order[k])
            )[:n]
        self.last = ("", None)
        out = [(score, ids)]
        for t, _, way in ways[1:]:
            parts, end = [], 0
            for k, place in zip(open_, reversed(way), strict=True):
                w = order[k][place]
                if w:
                    parts += [ids[end : int(ends[k] - size[k])], np.array(of[k][w][1], np.int32)]
                    end = int(ends[k])
            out.append((-t, np.concatenate([*parts, ids[end:]])))
        return ids, out, same

    def nbest(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations of a text as (score, ids)."""
        return [(score, ids.tolist()) for score, ids in self.encode(text, n)[1]]

    def decode(self, ids: list[int]) -> str:
        """The text that was encoded, exactly."""
        return b"".join(map(self.text.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def _encode(vocabulary, n: int, wide: bool):
    dtype = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one per task: a worker serves other operators too, and must not hold this one's memory meanwhile
        seg = Segmenter(*vocabulary.value)
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            sizes, scores, ids, shas, n_scores, n_sizes, n_ids, same = [], [], [], [], [], [], [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                row, ways, whole = seg.encode(text, n)
                raw = row.astype(dtype).tobytes()
                sizes.append(len(row)), scores.append(ways[0][0]), ids.append(raw)
                shas.append(hashlib.sha256(raw).hexdigest())
                n_scores.append([w[0] for w in ways]), n_sizes.append([len(w[1]) for w in ways])
                n_ids.append([raw, *(w[1].astype(dtype).tobytes() for w in ways[1:])])
                same.append(whole)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(scores, pa.float64()),
                    pa.array(ids, pa.binary()),
                    pa.array(shas, pa.string()),
                    pa.array(n_scores, pa.list_(pa.float64())),
                    pa.array(n_sizes, pa.list_(pa.int64())),
                    pa.array(n_ids, pa.list_(pa.binary())),
                    pa.array(same, pa.bool_()),
                ],
                ["doc_id", "n_pieces", "score", "ids", "ids_sha256", "nbest_scores", "nbest_pieces", "nbest_ids", "round_trip"],
            )

    return run


def encode_documents(docs: DataFrame, n: int = N_BEST, model: str = MODEL) -> DataFrame:
    """Per row: the best segmentation (ids as little-endian numbers of 2 or 4 bytes), its size, score and digest, scores,
    sizes and ids of the ``n`` best (the first of them is the best), and whether the ids decode to the text exactly.

    Defined cases: a null or empty text has no pieces and one segmentation of score 0; characters without a piece become
    byte pieces; ties follow the one order of ``Segmenter``; a very long text costs time in proportion to its length and,
    beyond its own ids, memory in proportion to its longest run without spaces (about 200 bytes a character); rows
    repeated are encoded each; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    vocabulary = load(model)
    sent = spark.sparkContext.broadcast(vocabulary)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _encode(sent, n, len(vocabulary[2]) > 65536),
        f"doc_id {id_type}, n_pieces long, score double, ids binary, ids_sha256 string, nbest_scores array<double>, "
        "nbest_pieces array<long>, nbest_ids array<binary>, round_trip boolean",
    )


def decode_documents(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, text`` of the rows of ``encode_documents``.

    Defined cases: null ids give the empty text; repeated rows are decoded each; an empty table gives an empty result;
    long rows cost memory in proportion to their text; other columns, of any name, are ignored.
    """
    vocabulary = load(model)
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)
    dtype = "<u4" if len(vocabulary[2]) > 65536 else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = Segmenter(*sent.value)
        for batch in batches:
            texts = [seg.decode(np.frombuffer(v.as_py() or b"", dtype).tolist()) for v in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.select(F.col("doc_id"), "ids").mapInArrow(run, f"doc_id {id_type}, text string")
