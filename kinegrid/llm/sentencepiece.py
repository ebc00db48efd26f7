"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once. At each position it
reports, along its output links, all pieces that end there, and a Viterbi step
relaxes the best score of that position with each of them. Texts are cut where no
piece reaches across; the automaton's table of moves takes a step in all of these
segments at once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The character that stands for a space.
SPACE = "▁"
#: How far below the worst piece a character without a piece scores.
UNKNOWN_PENALTY = 10.0
#: Spaces become ``SPACE``; a ``SPACE`` of the text itself becomes a space, which no piece has.
MARKED = {ord(" "): SPACE, ord(SPACE): " "}
#: Longer segments are read one by one; so many characters are read together.
LONG, BLOCK = 128, 1 << 20
#: What ends at a character: no piece, or its bytes.
INSIDE, BYTES = -2, -1
UNREACHED = float("-inf")


class Pieces:
    """The pieces of a SentencePiece model: encode texts to ids, and ids back to the same texts.

    Text is not normalised. A space is put before it, and all spaces become
    ``SPACE``. The segmentation has the highest sum of piece scores; of equal
    ones the piece reported first, the longest, stays. A character without a
    piece, and a ``SPACE`` in the text itself, becomes its UTF-8 bytes, so that
    decoding gives back every text exactly. Cuts between segments are exact.
    """

    def __init__(self, model: bytes):
        source = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes, self.text = {}, {}
        self.automaton = ahocorasick.Automaton()
        lowest = 0.0
        for k in range(source.get_piece_size()):
            piece = source.id_to_piece(k)
            if source.is_byte(k):
                self.bytes[int(piece[3:5], 16)] = k
            elif not (source.is_control(k) or source.is_unknown(k) or source.is_unused(k) or " " in piece):
                score = source.get_score(k)
                self.automaton.add_word(piece, (len(piece), score, k))
                self.text[k] = piece
                lowest = min(lowest, score)
        self.automaton.make_automaton()
        self.single = frozenset(p for p in self.text.values() if len(p) == 1)
        self.unknown = lowest - UNKNOWN_PENALTY
        raw = {k: bytes([b]) for b, k in self.bytes.items()} | {k: p.replace(SPACE, " ").encode() for k, p in self.text.items()}
        self.raw = [raw.get(k, b"") for k in range(source.get_piece_size())]
        if len(self.bytes) < 256:
            raise ValueError("the model has no piece for every byte")
        self.column = pa.array(self.raw, pa.binary())
        # pieces with a space after another character would tie words together
        self.split = not any(SPACE in p.lstrip(SPACE) for p in self.text.values())
        self._tables()

    def _tables(self) -> None:
        """The automaton as arrays: moves, and the pieces of two or more characters that end in each state, shortest first."""
        self.byte_ids = np.array([self.bytes[b] for b in range(256)], np.int32)
        self.score, self.length = np.full(len(self.raw) + 1, self.unknown), np.ones(len(self.raw) + 1, np.int64)  # BYTES is the last
        pairs = {p: k for k, p in self.text.items() if len(p) > 1}
        for p, (n, score, k) in self.automaton.items():
            self.score[k], self.length[k] = score, n
        # by code point: the piece of one character, the column of moves, and which characters pieces tie together
        self.one = np.full(0x110000, BYTES, np.int32)
        self.kind = np.zeros(0x110000, np.int32)
        self.tied = np.zeros(0x110000, np.int32)
        point = lambda c: ord(c.translate(MARKED))
        for k, p in self.text.items():
            if len(p) == 1:
                self.one[point(p)] = k
        column = {c: n for n, c in enumerate(sorted({c for p in pairs for c in p}), 1)}
        for c, n in column.items():
            self.kind[point(c)] = n
        roots = ties(pairs)
        number = {r: n for n, r in enumerate(sorted(set(roots.values())), 1)}
        for c, r in roots.items():
            self.tied[point(c)] = number[r]
        states = [""]
        for n in range(1, max(map(len, pairs), default=0) + 1):  # level by level, in the order of the states above
            level = {p[:n] for p in pairs if len(p) >= n}
            states += sorted(level)
        at = {p: n for n, p in enumerate(states)}
        above = np.array([at[p[:-1]] for p in states])
        by = np.array([0, *(column[p[-1]] for p in states[1:])])
        below = np.searchsorted(above[1:], np.arange(len(states) + 1)) + 1  # a state's own moves go to neighbours
        self.moves = np.zeros((len(states), len(column) + 1), np.uint16 if len(states) < 1 << 16 else np.int32)
        ends: list[list[int]] = []
        for n, p in enumerate(states):  # a state after those that it falls back to
            back = next((at[p[k:]] for k in range(1, len(p)) if p[k:] in at), 0)
            some = slice(below[n], below[n + 1])
            self.moves[n] = self.moves[back]
            self.moves[n, by[some]] = range(some.start, some.stop)
            ends.append(ends[back] + [pairs[p]] if p in pairs else ends[back] if n else [])
        self.n_ends = np.array([len(e) for e in ends], np.int64)
        self.first_end = self.n_ends.cumsum() - self.n_ends
        self.ends = np.array([k for e in ends for k in e], np.int32)

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text]).values.tolist()

    def encode_all(self, texts: Sequence[str]) -> pa.ListArray:
        ids, sizes, group, chars = [], [], [], 0
        for n, text in enumerate(texts, 1):
            group.append(text)
            chars += len(text)
            if chars >= BLOCK or n == len(texts):
                some, counts = self._encode(group)
                ids.append(some)
                sizes.append(counts)
                group, chars = [], 0
        bounds = np.r_[0, np.concatenate([np.zeros(0, np.int64), *sizes]).cumsum()]
        return pa.ListArray.from_arrays(bounds.astype(np.int32), np.concatenate([np.zeros(0, np.int32), *ids]))

    def _encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        points = np.frombuffer("".join(f" {t}" for t in texts if t).encode("utf-32-le"), np.uint32)
        bounds = np.r_[0, np.cumsum([len(t) + 1 if t else 0 for t in texts])]
        cut = np.zeros(len(points) + 1, bool)
        cut[bounds] = True
        if self.split:
            space, tied = points == ord(" "), self.tied[points]
            cut[1:-1] |= ~space[:-1] & (space[1:] | (tied[1:] != tied[:-1]) | (tied[1:] == 0))
        first = np.flatnonzero(cut)
        size = np.diff(first)
        path = np.full(len(points), INSIDE, np.int32)
        for n in np.flatnonzero(size > LONG):
            a, b = first[n], first[n + 1]
            for end, k in self.viterbi(points[a:b].tobytes().decode("utf-32-le").translate(MARKED)):
                path[a + end - 1] = k
        short = np.flatnonzero(size <= LONG)
        blocks = np.flatnonzero(np.diff(size[short].cumsum() // BLOCK)) + 1
        for some in np.split(short, blocks):
            self._steps(points, first[some], size[some], path)
        on = np.flatnonzero(path != INSIDE)
        k = path[on]
        plain = k != BYTES
        width = np.where(plain, 1, 1 + sum((points[on] >= least).astype(np.int64) for least in (0x80, 0x800, 0x10000)))
        ids = np.repeat(k, width)
        spelled = points[on[~plain]].tobytes().decode("utf-32-le").encode()
        ids[ids == BYTES] = self.byte_ids[np.frombuffer(spelled, np.uint8)]
        return ids, np.diff(np.r_[0, width.cumsum()][np.searchsorted(on, bounds)])

    def _steps(self, points: np.ndarray, first: np.ndarray, size: np.ndarray, path: np.ndarray) -> None:
        """``viterbi`` in all segments at once, a character of each at a step. Row t has the best scores after t characters, longest segments first."""
        if not len(size):
            return
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        rows = np.searchsorted(-size, -np.arange(size[0] + 1), side="right")  # segments of t characters or more
        row = rows.cumsum() - rows
        best, back = np.zeros(rows.sum()), np.zeros(rows.sum(), np.int32)
        state = np.zeros(len(size), self.moves.dtype)
        for t in range(size[0]):
            n = rows[t + 1]
            at = points[first[:n] + t]
            state = self.moves[state[:n], self.kind[at]]
            pick = self.one[at]
            top = best[row[t] : row[t] + n] + self.score[pick]
            count = self.n_ends[state]
            some, j = np.flatnonzero(count), 0
            while len(some):
                k = self.ends[self.first_end[state[some]] + j]
                total = best[row[t + 1 - self.length[k]] + some] + self.score[k]
                better = total >= top[some]  # of equal ones the longest
                top[some[better]], pick[some[better]] = total[better], k[better]
                j += 1
                some = some[count[some] > j]
            best[row[t + 1] : row[t + 1] + n], back[row[t + 1] : row[t + 1] + n] = top, pick
        left, which = size, np.arange(len(size))
        while len(which):
            k = back[row[left] + which]
            path[first[which] + left - 1] = k
            left = left - self.length[k]
            which, left = which[left > 0], left[left > 0]

    def viterbi(self, segment: str) -> list[tuple[int, int]]:
        """Where pieces end, and which, last one first."""
        n = len(segment)
        best, back = [UNREACHED] * (n + 1), [(0, BYTES)] * (n + 1)
        best[0] = 0.0
        unknown = [] if self.single.issuperset(segment) else [p for p, c in enumerate(segment) if c not in self.single]
        at = 0
        for end, (length, score, k) in self.automaton.iter(segment):
            while at < len(unknown) and unknown[at] < end:  # no piece ends there
                p = unknown[at]
                at += 1
                if best[p] + self.unknown > best[p + 1]:
                    best[p + 1], back[p + 1] = best[p] + self.unknown, (p, BYTES)
            start = end + 1 - length
            total = best[start] + score
            if total > best[end + 1]:
                best[end + 1], back[end + 1] = total, (start, k)
            if at < len(unknown) and unknown[at] == end and best[end] + self.unknown > best[end + 1]:
                best[end + 1], back[end + 1] = best[end] + self.unknown, (end, BYTES)
        for p in unknown[at:]:
            if best[p] + self.unknown > best[p + 1]:
                best[p + 1], back[p + 1] = best[p] + self.unknown, (p, BYTES)
        out: list[tuple[int, int]] = []
        while n:
            start, k = back[n]
            out.append((n, k))
            n = start
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """Control pieces stand for no text."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]

    def decode_all(self, ids: pa.ListArray) -> list[str]:
        texts = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.column.take(ids.values)), b"")
        return [t.decode("utf-8", "replace")[1:] for t in texts.to_pylist()]


def ties(pieces: Iterable[str]) -> dict[str, str]:
    """Characters that pieces have side by side, directly or over others, have the same value; spaces before a piece don't count."""
    above: dict[str, str] = {}

    def root(c: str) -> str:
        while above.setdefault(c, c) != c:
            c = above[c]
        return c

    for piece in pieces:
        piece = piece.lstrip(SPACE)
        for a, b in itertools.pairwise(piece):
            above[root(a)] = root(b)
    return {c: root(c) for c in list(above)}


_LOADED: dict[int, Pieces] = {}


def _pieces(model: bytes) -> Pieces:
    """One automaton per Python worker."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def encode_texts(docs: DataFrame, model_path: str = MODEL, text: str = "text") -> DataFrame:
    """``docs`` with piece_ids, n_pieces and round_trip (the ids decode to the very text).

    A null or empty text has no pieces. Columns of ``docs`` named like an added
    one are replaced. One pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary, whatever the corpus
    added = {"piece_ids": pa.list_(pa.int32()), "n_pieces": pa.int64(), "round_trip": pa.bool_()}
    rest = [c for c in docs.columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared.value)
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            ids = pieces.encode_all(texts)
            same = [back == t for back, t in zip(pieces.decode_all(ids), texts, strict=True)]
            new = [ids, pa.array(np.diff(ids.offsets).astype(np.int64)), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*map(b.column, rest), *new], [*rest, *added])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest]
    return docs.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(run, ", ".join([*kinds, "piece_ids array<int>, n_pieces long, round_trip boolean"]))


def decode_pieces(encoded: DataFrame, model_path: str = MODEL, ids: str = "piece_ids") -> DataFrame:
    """``encoded`` with column text, decoded from ``ids``; null ids give an empty text."""
    with open(model_path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())
    rest = [c for c in encoded.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared.value)
        for b in batches:
            texts = [pieces.decode(i or []) for i in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*map(b.column, rest), pa.array(texts, pa.string())], [*rest, "text"])

    kinds = [f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in rest]
    return encoded.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(run, ", ".join([*kinds, "text string"]))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every whole text, and whether they decode to it; a row for each, in no order. A null text has no pieces."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_texts(docs)
    return encoded.select("doc_id", "n_pieces", "piece_ids", "round_trip")
