"""Byte-level BPE encoding and decoding, long texts in overlapping chunks.

A text is split into pre-tokens, and each is encoded by itself. What a match of
the pattern is depends on the text from its start on, never on what lies before.
So a long text can be cut into overlapping chunks that are split in parallel,
each from its own start: once two neighbours share a boundary in their overlap,
they agree from there on, and that is where they are stitched.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .common import small_batches, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Characters of a chunk, and of the next one that it reads as well.
CHUNK, OVERLAP = 32_768, 512
#: A match of the pattern never depends on more than so many characters after it.
LOOK = 2
#: Encoded pre-tokens that a worker remembers at most, and the longest of them.
CACHE, CACHE_CHARS = 200_000, 40


def _same_classes(pattern: str) -> tuple[frozenset[str], regex.Pattern]:
    """Characters that the two regular-expression engines class differently, and ``pattern`` with classes as the encoder has them.

    Engines know different versions of Unicode; the differences are characters
    that were added lately.
    """
    every = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], "<u4").tobytes().decode("utf-32-le")
    raw = {bytes([b]): b for b in range(256)}
    codes = lambda text: np.frombuffer(text.encode("utf-32-le"), "<u4")
    odd, exact = [], pattern
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        lister = tiktoken.Encoding("class", pat_str=f"{name}+", mergeable_ranks=raw, special_tokens={})
        theirs = codes(bytes(lister.encode_to_numpy(every).astype(np.uint8)).decode())
        ours = codes("".join(regex.findall(f"{name}+", every)))
        more, less = np.setdiff1d(theirs, ours), np.setdiff1d(ours, theirs)
        odd += [more, less]
        if len(more) or len(less):
            # inside a set of its own, so that it also stands within the brackets of the pattern
            exact = exact.replace(name, f"[[{name}{_ranges(more)}]{f'--[{_ranges(less)}]' if len(less) else ''}]")
    return frozenset(np.concatenate(odd).astype("<u4").tobytes().decode("utf-32-le")), regex.compile(exact, regex.V1)


def _ranges(codes: np.ndarray) -> str:
    if not len(codes):
        return ""
    breaks = np.flatnonzero(np.diff(codes) > 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(codes[[0, *(breaks + 1)]].tolist(), codes[[*breaks, -1]].tolist(), strict=True))


class Tokens:
    """The bytes of each id of a vocabulary, which is all that decoding needs."""

    def __init__(self, ranks: bytes):
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, filter(None, ranks.splitlines()))]
        self.raw = [b""] * (max(pairs)[0] + 1)
        for rank, token in pairs:
            self.raw[rank] = token

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids.tolist()))


class ByteBpe(Tokens):
    """The ranks of a byte-level BPE vocabulary: texts to ids, ids to bytes."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        super().__init__(ranks)
        self.ranks = {token: rank for rank, token in enumerate(self.raw) if token}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.odd, self.exact = _same_classes(pattern)
        self.cache: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text, in order."""
        return (self.pattern if self.odd.isdisjoint(text) else self.exact).findall(text)

    def codes(self, pieces: list[str]) -> list[bytes]:
        """The ids of each pre-token, as the bytes of 32-bit numbers; pre-tokens recur, so they are remembered."""
        found = list(map(self.cache.get, pieces))
        if None in found:
            cache = self.cache
            for k, code in enumerate(found):
                if code is None:
                    piece = pieces[k]
                    code = cache.get(piece)
                    if code is None:
                        code = np.array(self._merged(piece), np.int32).tobytes()
                        if len(piece) <= CACHE_CHARS:
                            if len(cache) >= CACHE:
                                cache.clear()
                            cache[piece] = code
                    found[k] = code
        return found

    def _merged(self, piece: str) -> list[int]:
        rank = self.ranks.get(piece.encode())
        return [rank] if rank is not None else self.encoding.encode_ordinary(piece)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.codes(self.pieces(text))), np.int32)


_LOADED: dict[int, ByteBpe] = {}


def _bpe(ranks: bytes, pattern: str) -> ByteBpe:
    """One vocabulary per Python worker."""
    key = hash((ranks, pattern))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(ranks, pattern)
    return _LOADED[key]


def cut_text(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, bool, str]]:
    """(start, whether it is the last, text) of the chunks of a text; each reads on into the next by ``overlap``."""
    for start in range(0, max(len(text), 1), chunk):
        last = start + chunk >= len(text)
        yield start, last, text[start : start + chunk + overlap]


def split_chunk(bpe: ByteBpe, text: str, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, counts, ids) of the pre-tokens of a chunk, read from its start, whose ends can't change with what comes after it."""
    pieces = bpe.pieces(text)
    ends = np.cumsum([0, *map(len, pieces)])[1:]
    sure = len(pieces) if last else int(np.searchsorted(ends, len(text) - LOOK, "right"))
    codes = bpe.codes(pieces[:sure])
    return ends[:sure], np.fromiter(map(len, codes), np.int64, sure) // 4, np.frombuffer(b"".join(codes), np.int32)


@dataclass
class Stitch:
    """The ids of a text from its chunks, in order.

    ``at`` is a true boundary up to which all is encoded. ``tail`` is the text
    from there to the end of the last chunk: a pre-token that no chunk has
    finished. It is looked at again whenever it has doubled.
    """

    bpe: ByteBpe
    at: int = 0
    end: int = 0
    tail: str = ""
    tried: int = 0
    ids: list[np.ndarray] = field(default_factory=list)

    def add(self, start: int, last: bool, text: str, ends: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.tail += text[self.end - start :]
        self.end = start + len(text)
        bounds = np.concatenate([[start], start + ends])
        k = int(np.searchsorted(bounds, self.at))
        if k == len(bounds) or bounds[k] != self.at:
            if not last and len(self.tail) < 2 * self.tried:
                return
            k = self._read_on(bounds, last)
            if k < 0:
                return
        self.ids.append(ids[int(counts[:k].sum()) :])
        self._move(int(bounds[-1]))

    def _move(self, to: int) -> None:
        if to > self.at:
            self.tail, self.at, self.tried = self.tail[to - self.at :], to, 0

    def _read_on(self, bounds: np.ndarray, last: bool) -> int:
        """Encode from ``at`` until a boundary of the chunk is met; its place among ``bounds``, or -1."""
        pieces = self.bpe.pieces(self.tail)
        ends = self.at + np.cumsum([0, *map(len, pieces)])[1:]
        sure = len(pieces) if last else int(np.searchsorted(ends, self.end - LOOK, "right"))
        met = np.flatnonzero(np.isin(ends[:sure], bounds))
        n = int(met[0]) + 1 if len(met) else sure
        self.ids.append(np.frombuffer(b"".join(self.bpe.codes(pieces[:n])), np.int32))
        if n:
            self._move(int(ends[n - 1]))
        if len(met):
            return int(np.searchsorted(bounds, self.at))
        self.tried = len(self.tail)
        return -1

    def done(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int32), *self.ids])


def _encode_long(texts: DataFrame, shared, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(digest, token_ids) of distinct long texts (digest, text): cut, split in parallel, stitched in order."""
    ints = pa.list_(pa.int32())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for digest, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for start, last, part in cut_text(text.as_py(), chunk, overlap):
                    yield pa.RecordBatch.from_pydict({"digest": [digest], "start": [start], "last": [last], "text": [part]})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared.value, pattern)
        for b in batches:
            parts = [split_chunk(bpe, t, last) for t, last in zip(b.column(3).to_pylist(), b.column(2).to_pylist(), strict=True)]
            columns = [pa.array([p[k].astype(np.int32) for p in parts], ints) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], ["digest", "start", "last", "text", "ends", "counts", "ids"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            for k in range(b.num_rows):
                digest, start, last, text, *arrays = (c[k] for c in b.columns)
                if state is None:
                    state = Stitch(_bpe(shared.value, pattern))
                state.add(start.as_py(), last.as_py(), text.as_py(), *(a.values.to_numpy() for a in arrays))
                if last.as_py():
                    yield pa.RecordBatch.from_arrays([pa.array([digest.as_py()]), pa.array([state.done()], ints)], ["digest", "token_ids"])
                    state = None

    parts = texts.select("digest", "text").mapInArrow(cut, "digest string, start long, last boolean, text string")
    split_up = parts.repartition("digest", "start").mapInArrow(split, "digest string, start long, last boolean, text string, ends array<int>, counts array<int>, ids array<int>")
    return split_up.repartition("digest").sortWithinPartitions("digest", "start").mapInArrow(stitch, "digest string, token_ids array<int>")


def encode_texts(docs: DataFrame, ranks_path: str = RANKS, pattern: str = PATTERN, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with token_ids and n_tokens, for each match of ``pattern`` by itself, without special tokens.

    A null or empty text has no tokens. Columns of ``docs`` named like an added
    one are replaced. Texts of at most ``chunk`` bytes are one chunk and take
    one pass without a shuffle. Longer ones are encoded once however often they
    occur, in chunks that are dealt out over all tasks.
    """
    small_batches(docs.sparkSession)
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary, whatever the corpus
    added = ("token_ids", "n_tokens")
    rest = [c for c in docs.columns if c not in added]
    plain = docs.select(*(F.col(f"`{c}`") for c in rest))
    long = F.coalesce(F.octet_length(F.col(f"`{text}`")) > chunk, F.lit(False))
    kinds = StructType([*plain.schema, StructField("token_ids", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared.value, pattern)
        for b in batches:
            ids = [bpe.encode(t or "") for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], [*rest, "token_ids"])

    whole = plain.filter(~long).mapInArrow(run, kinds)
    # the columns travel as one, so that none can clash with those of the join
    row = F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row")
    longs = plain.filter(long).select(F.sha2(F.col(f"`{text}`"), 256).alias("digest"), row)
    texts = longs.groupBy("digest").agg(F.any_value(F.col(f"row.`{text}`")).alias("text"))
    joined = longs.join(_encode_long(texts, shared, pattern, chunk, overlap), "digest").select(*(F.col(f"row.`{c}`") for c in rest), "token_ids")
    return whole.unionByName(joined).withColumn("n_tokens", F.size("token_ids").cast("long"))


def decode_ids(encoded: DataFrame, ranks_path: str = RANKS, ids: str = "token_ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of ``ids`` one after the other; null ids give no bytes.

    They need not be UTF-8: a cut between two ids can fall inside a character.
    """
    small_batches(encoded.sparkSession)
    with open(ranks_path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())
    rest = [c for c in encoded.columns if c != "decoded"]
    plain = encoded.select(*(F.col(f"`{c}`") for c in rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(shared.value)
        for b in batches:
            column = b.column(ids)
            decoded = [tokens.decode(column[k].values.to_numpy()) if column[k].is_valid else b"" for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(decoded, pa.binary())], [*rest, "decoded"])

    return plain.mapInArrow(run, StructType([*plain.schema, StructField("decoded", BinaryType())]))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text, and of the bytes they decode to; a row for each, in no order.

    A null text counts as empty: no tokens, and the digests of nothing. Rows
    that repeat a doc_id, or have none, are rows of their own.
    """
    encoded = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    decoded = decode_ids(encoded.select("doc_id", "n_tokens", "token_ids"))
    return decoded.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
