"""Which tokens of one tokenizer stand for which of another.

Both cut the same bytes. Offsets at which tokens of both end cut a text into
groups, and all tokens of a group are linked with each other. Most groups are a
single token on either side with the same bytes, known from a map of ids made
beforehand; those are counted in vectors as long as the vocabulary. Pairs of the
other groups are counted in a shuffle.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from .common import cut, shared_dir, small_batches, table

TOKENIZER_A, MODEL_B = (public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
#: The character that stands for a space in pieces of B.
SPACE = "▁"
#: Encoded stretches of text that a worker remembers at most, and the longest of them.
CACHE, CACHE_CHARS = 400_000, 40
#: Characters that are aligned together, or one text if it is longer.
BATCH_CHARS = 500_000
#: Groups with more links than that are reduced to their different ids first.
WIDE = 64
#: Pairs that a counting worker holds before it hands them on, and pairs that are looked up without a shuffle.
HELD_PAIRS, FREQUENT = 500_000, 1 << 20
#: Stands for a stretch that isn't remembered.
MISSING = ()
_GAP = re.compile(r"\s ")
_JOINT = re.compile(r"(?<=\S)(?= )")

COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Aligned:
    """The alignment of some texts. ``counts`` has a row (``COUNTS``) for each, ``groups`` its groups as text.

    The links of text k are those from ``bounds[k]`` to ``bounds[k + 1]``: ids
    of A and B, every pair once, and how often it occurs.
    """

    counts: np.ndarray
    groups: list[str]
    bounds: np.ndarray
    a: np.ndarray
    b: np.ndarray
    times: np.ndarray


def _packed(ids: list[list[int]]) -> tuple[bytes, list[int]]:
    """All ids as the bytes of 32-bit numbers, and where those of each list begin and end."""
    return np.fromiter(chain.from_iterable(ids), np.int32).tobytes(), [0, *(4 * np.cumsum([*map(len, ids)])).tolist()]


def _fast_encoder(rules: dict, ranks: dict[bytes, int]) -> tiktoken.Encoding | None:
    """The same encoding by ranks, if the merges of a byte-level tokenizer come in order of their ids; it is three times as fast."""
    model, ids = rules["model"], list(range(256, 256 + len(rules["model"].get("merges", []))))
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model.get("merges", [])]
    plain = model.get("type", "BPE") == "BPE" and not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"))
    fits = plain and merged == ids and len(ranks) == 256 + len(ids) and not rules["pre_tokenizer"].get("add_prefix_space")
    return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if fits else None


class Aligner:
    """Aligns the tokens of a byte-level BPE tokenizer (A) and a SentencePiece model (B)."""

    def __init__(self, tokenizer: str, model: bytes):
        self.a = Tokenizer.from_str(tokenizer)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        alphabet, size = byte_alphabet(), self.a.get_vocab_size(True)
        raw_a = [b""] * size
        for token, k in self.a.get_vocab(True).items():
            raw_a[k] = bytes(map(alphabet.get, token)) if all(c in alphabet for c in token) else token.encode()
        raw_b = [b""] * self.b.get_piece_size()
        for k in range(len(raw_b)):
            piece = self.b.id_to_piece(k)
            if self.b.is_byte(k):
                raw_b[k] = bytes([int(piece[3:5], 16)])
            elif not (self.b.is_control(k) or self.b.is_unknown(k)):
                raw_b[k] = piece.replace(SPACE, " ").encode()
        self.raw_a, self.raw_b = raw_a, raw_b
        self.length_a, self.length_b = np.array([*map(len, raw_a)]), np.array([*map(len, raw_b)])
        # of pieces with the same bytes a written one goes before a byte's
        known = {raw: k for k, raw in reversed([*enumerate(raw_b)]) if self.b.is_byte(k)} | {raw: k for k, raw in reversed([*enumerate(raw_b)]) if not self.b.is_byte(k)}
        self.same = np.array([known.get(raw, -1) if raw else -1 for raw in raw_a], np.int64)
        self.size_b = len(raw_b)
        # decimal ids and the sign after them
        self.signs = [f"{k}{s}" for s in ",|" for k in range(size)] + [f"{k}{s}" for s in ",;" for k in range(self.size_b)]
        rules = json.loads(tokenizer)
        before = rules.get("pre_tokenizer") or {}
        # between a character and a space neither tokenizer joins anything, so stretches can be aligned by themselves
        self.split = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not rules.get("normalizer") and not any(b" " in r.lstrip(b" ") for r in raw_b)
        #: Ids of A and B of stretches, as the bytes of 32-bit numbers: those looked up lately, and those before.
        fast = _fast_encoder(rules, {raw_a[k]: k for k in rules["model"]["vocab"].values()}) if self.split else None
        self.encode_a: Callable[[list[str]], list[list[int]]] = (lambda texts: [*map(fast.encode_ordinary, texts)]) if fast else (lambda texts: [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)])
        self.young: dict[str, tuple[bytes, bytes] | None] = {}
        self.old: dict[str, tuple[bytes, bytes] | None] = {}

    def stretches(self, text: str) -> list[str]:
        """``text`` with a space before it, cut before each space that follows another character; without the first space of each."""
        if not self.split:
            return [text]
        parts = [s[1:] for s in _JOINT.split(" " + text)] if _GAP.search(" " + text) else text.split(" ")
        if not parts[-1] and len(parts) > 1:  # a space at the end stays with what is before it, as B has no tokens for nothing
            parts[-2:] = [parts[-2] + " "]
        return parts

    def token_ids(self, texts: Sequence[str]) -> list[tuple[bytes, bytes] | None]:
        """The ids of A and B of each text; None without a text, or where they don't join to it with a space before it."""
        cut_up = [self.stretches(t) if t else [] for t in texts]
        parts = [s for p in cut_up for s in p]
        found = [*map(self.young.get, parts, repeat(MISSING))]
        if MISSING in found:
            fresh = self._fresh(dict.fromkeys(s for s, x in zip(parts, found, strict=True) if x is MISSING))
            found = [fresh[s] if x is MISSING else x for s, x in zip(parts, found, strict=True)]
        out, at = [], 0
        for p in cut_up:
            own = found[at : at + len(p)]
            at += len(p)
            out.append(None if not own or None in own else (b"".join([x[0] for x in own]), b"".join([x[1] for x in own])))
        return out

    def _fresh(self, wanted: dict[str, None]) -> dict[str, tuple[bytes, bytes] | None]:
        fresh = {s: self.old[s] for s in wanted if s in self.old}
        new = [s for s in wanted if s not in fresh]
        if new:
            texts = [" " + s for s in new]
            (blob_a, at_a), (blob_b, at_b) = packed = [_packed(ids) for ids in (self.encode_a(texts), self.b.encode(new, num_threads=1))]
            fits = repeat(True)
            raws = ((self.raw_a, *packed[0]), (self.raw_b, *packed[1]))
            if any(b"".join(map(raw.__getitem__, np.frombuffer(blob, np.int32).tolist())) != "".join(texts).encode() for raw, blob, _ in raws) or not np.array_equal(*(self._octets(raw, blob, at) for raw, blob, at in raws)):
                join = lambda raw, blob: b"".join(map(raw.__getitem__, np.frombuffer(blob, np.int32).tolist()))
                fits = [all(join(raw, blob[at[k] : at[k + 1]]) == t.encode() for raw, blob, at in raws) for k, t in enumerate(texts)]
            fresh |= {s: (blob_a[i:j], blob_b[k:n]) if f else None for s, i, j, k, n, f in zip(new, at_a, at_a[1:], at_b, at_b[1:], fits)}  # noqa: B905
        if len(self.young) > CACHE // 2:
            self.young, self.old = {}, self.young
        self.young.update((s, x) for s, x in fresh.items() if len(s) <= CACHE_CHARS)
        return fresh

    def _octets(self, raw: list[bytes], blob: bytes, at: list[int]) -> np.ndarray:
        """Where in the joined bytes the tokens of each stretch end."""
        lengths = self.length_a if raw is self.raw_a else self.length_b
        return np.concatenate([[0], lengths[np.frombuffer(blob, np.int32)].cumsum()])[np.array(at) // 4]

    def align(self, texts: Sequence[str]) -> Aligned:
        """All texts at once: offsets run on from one to the next, as each ends a token on both sides."""
        ids = [x or (b"", b"") for x in self.token_ids(texts)]
        a, b = (np.frombuffer(b"".join(x[k] for x in ids), np.int32).astype(np.int64) for k in (0, 1))
        n_a, n_b = (np.fromiter((len(x[k]) // 4 for x in ids), np.int64, len(ids)) for k in (0, 1))
        ends_a, ends_b = self.length_a[a].cumsum(), self.length_b[b].cumsum()
        stops_a, stops_b = n_a.cumsum(), n_b.cumsum()
        ends = [np.zeros((ends_a[-1] if len(a) else 0) + 1, bool) for _ in range(2)]
        ends[0][ends_a], ends[1][ends_b] = True, True
        common = ends[0] & ends[1]
        before = common.cumsum() - common
        group_a, group_b, n = before[ends_a], before[ends_b], int(common.sum())
        size_a, size_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        first_a, first_b = size_a.cumsum() - size_a, size_b.cumsum() - size_b
        bytes_to = np.concatenate([[0], ends_a])[stops_a]
        stops = (before + common)[bytes_to]
        links = size_a * size_b
        sums = np.concatenate([[0], links.cumsum()])[stops]
        counts = np.stack([n_a, n_b, np.diff(stops, prepend=0), np.diff(sums, prepend=0)], 1)
        # ids of A are written after those of B of the groups before, ids of B after those of A of their own group
        signs = np.empty(len(a) + len(b), np.int64)
        signs[np.arange(len(a)) + first_b[group_a]] = a + np.append(np.diff(group_a) > 0, True)[: len(a)] * len(self.raw_a)
        signs[np.arange(len(b)) + (first_a + size_a)[group_b]] = b + 2 * len(self.raw_a) + np.append(np.diff(group_b) > 0, True)[: len(b)] * self.size_b
        written = [*map(self.signs.__getitem__, signs.tolist())]
        cuts = [0, *(stops_a + stops_b).tolist()]
        groups = ["".join(written[low:high])[:-1] for low, high in zip(cuts, cuts[1:], strict=False)]
        group, codes, times = self._links(a, b, size_a, size_b, first_a, first_b, links)
        every = len(self.raw_a) * self.size_b
        codes, times = summed(np.searchsorted(stops, group, "right") * every + codes, times)
        text, codes = np.divmod(codes, every)
        return Aligned(counts, groups, np.searchsorted(text, np.arange(len(texts) + 1)), *np.divmod(codes, self.size_b), times)

    def _links(self, a, b, size_a, size_b, first_a, first_b, links) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, code, times) of all links, by group."""
        few = np.flatnonzero(links <= WIDE)
        of = np.repeat(few, links[few])
        place = np.arange(len(of)) - np.repeat(links[few].cumsum() - links[few], links[few])
        codes = a[first_a[of] + place // size_b[of]] * self.size_b + b[first_b[of] + place % size_b[of]]
        wide = []
        for g in np.flatnonzero(links > WIDE).tolist():
            x, nx = np.unique(a[first_a[g] : first_a[g] + size_a[g]], return_counts=True)
            y, ny = np.unique(b[first_b[g] : first_b[g] + size_b[g]], return_counts=True)
            wide.append((np.full(len(x) * len(y), g), (x[:, None] * self.size_b + y).ravel(), np.outer(nx, ny).ravel()))
        if not wide:
            return of, codes, np.ones(len(of), np.int64)
        group, codes, times = (np.concatenate(c) for c in zip((of, codes, np.ones(len(of), np.int64)), *wide, strict=True))
        order = np.argsort(group, kind="stable")
        return group[order], codes[order], times[order]


_LOADED: dict[int, Aligner] = {}


def _aligner(tokenizer: str, model: bytes) -> Aligner:
    """One per Python worker."""
    key = hash((tokenizer, model))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Aligner(tokenizer, model)
    return _LOADED[key]


def summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different codes, ascending, and the sum of the times of each."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[starts], np.add.reduceat(times[order], starts) if len(codes) else times[:0]


def _files(spark: SparkSession, tokenizer_path: str, model_path: str):
    """Both vocabularies for the workers; their size doesn't depend on the corpus."""
    with open(tokenizer_path, encoding="utf-8") as a, open(model_path, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


def align_texts(docs: DataFrame, tokenizer_path: str = TOKENIZER_A, model_path: str = MODEL_B, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` replaced by n_a, n_b, n_groups, n_links, groups, pair_a, pair_b and pair_n; one pass, no shuffle.

    groups lists the ids of each group, as in ``a1,a2|b1;a3|b2,b3``. The pairs
    are the different links, and how often each occurs. A text that is null or
    empty, or whose tokens don't join to it, has no tokens: zeros, empty text
    and arrays. Other columns of the added names are replaced.
    """
    small_batches(docs.sparkSession, 256)
    shared = _files(docs.sparkSession, tokenizer_path, model_path)
    added = [*COUNTS, "groups", "pair_a", "pair_b", "pair_n"]
    rest = [c for c in docs.columns if c != text and c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            first, chars = 0, 0
            for row, t in enumerate(texts):
                chars += len(t)
                if chars > BATCH_CHARS or row == len(texts) - 1:
                    found = aligner.align(texts[first : row + 1])
                    lists = [pa.ListArray.from_arrays(pa.array(found.bounds, pa.int32()), pa.array(x, k)) for x, k in ((found.a, pa.int32()), (found.b, pa.int32()), (found.times, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, row + 1 - first), *(pa.array(c) for c in found.counts.T), pa.array(found.groups, pa.string()), *lists], ["row", *added])
                    first, chars = row + 1, 0

    # the other columns travel as one, so that none can clash
    row = F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(0).alias("_")).alias("row")
    carried = docs.select(F.col(f"`{text}`").alias("text"), row)
    kinds = [*((c, LongType()) for c in COUNTS), ("groups", StringType()), ("pair_a", ArrayType(IntegerType())), ("pair_b", ArrayType(IntegerType())), ("pair_n", ArrayType(LongType()))]
    found = carried.mapInArrow(run, StructType([carried.schema["row"], *(StructField(*k) for k in kinds)]))
    return found.select(*(F.col(f"row.`{c}`") for c in rest), *added)


def pair_counts(aligned: DataFrame, tokenizer_path: str = TOKENIZER_A, model_path: str = MODEL_B) -> DataFrame:
    """(a, b, n, same): how many rows of ``aligned`` hold each pair of ids, and whether both have the same bytes.

    Pairs with the same bytes are counted in a vector per task, which gives a
    row per id of A at most. The others are summed in a task as far as they fit
    and then by Spark.
    """
    shared = _files(aligned.sparkSession, tokenizer_path, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*shared.value)
        vector = np.zeros(len(aligner.same), np.int64)
        codes, times, held = [], [], 0

        def rows(codes: np.ndarray, n: np.ndarray, same: bool) -> pa.RecordBatch:
            a, b = np.divmod(codes, aligner.size_b)
            return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(n), pa.array(np.full(len(n), same))], ["a", "b", "n", "same"])

        for batch in batches:
            a, b = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (0, 1))
            alike = aligner.same[a] == b
            vector += np.bincount(a[alike], minlength=len(vector))
            other = a[~alike] * aligner.size_b + b[~alike]
            codes.append(other)
            times.append(np.ones(len(other), np.int64))
            held += len(other)
            if held > 4 * HELD_PAIRS:
                one, n = summed(np.concatenate(codes), np.concatenate(times))
                codes, times, held = [one], [n], len(one)
                if held > HELD_PAIRS:
                    yield rows(one, n, False)
                    codes, times, held = [], [], 0
        if codes:
            yield rows(*summed(np.concatenate(codes), np.concatenate(times)), False)
        ids = np.flatnonzero(vector)
        yield rows(ids * aligner.size_b + aligner.same[ids], vector[ids], True)

    tallied = aligned.select("pair_a", "pair_b").mapInArrow(run, "a int, b int, n long, same boolean")
    return tallied.groupBy("a", "b", "same").agg(F.sum("n").alias("n")).select("a", "b", "n", "same")


def link_totals(aligned: DataFrame, counts: DataFrame, key: str, frequent: int = FREQUENT) -> DataFrame:
    """(key, n_best, count_sum) of each row of ``aligned``, whose ``key`` is unique.

    A link is best if no pair with its id of A has a higher count. Pairs with
    the same bytes, and at most ``frequent`` of the others, those with the
    highest counts, are looked up where the rows are. Links of rarer pairs are
    joined with their counts; a rare pair is no hot key.
    """
    spark = aligned.sparkSession
    best = counts.groupBy("a").agg(F.max("n").alias("best"))  # a row per id of A at most
    known = cut(counts.join(F.broadcast(best), "a").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "n", "same", (F.col("n") == F.col("best")).alias("best")))
    width = (known.agg(F.max("b")).first()[0] or 0) + 1
    # from a power of two on there are at most ``frequent`` pairs
    sizes = dict(known.filter("not same").groupBy(F.floor(F.log2("n")).alias("p")).count().collect())
    power, total = 64, 0
    for p in sorted(sizes, reverse=True):
        total += sizes[p]
        if total > frequent:
            break
        power = p
    near = F.col("same") | (F.col("n") >= F.lit(2**power if power < 63 else 2**63 - 1))
    looked_up = known.filter(near).select((F.col("a") * width + F.col("b")).alias("code"), "n", "best").orderBy("code").toArrow()
    shared = spark.sparkContext.broadcast([looked_up.column(c).to_numpy() for c in ("code", "n", "best")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = shared.value
        for batch in batches:
            keys, a, b, times = batch.column(0).to_numpy(), *(batch.column(k) for k in (1, 2, 3))
            sizes = pa.compute.list_value_length(a).to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            a, b, times = (x.flatten().to_numpy().astype(np.int64) for x in (a, b, times))
            wanted = a * width + b
            at = np.minimum(np.searchsorted(code, wanted), max(len(code) - 1, 0))
            hit = code[at] == wanted if len(code) else np.zeros(len(wanted), bool)
            add = lambda v, hit=hit, row=row, sizes=sizes: np.bincount(row[hit], v, len(sizes)).astype(np.int64)  # noqa: E731  below 2^53
            bests, sums = add((times * best[at])[hit] if len(code) else times[:0]), add((times * n[at])[hit] if len(code) else times[:0])
            none = np.zeros(len(sizes), np.int64)
            columns = [(keys, -1 - keys, none, none, bests, sums), (keys[row[~hit]], a[~hit], b[~hit], times[~hit], none[row[~hit]], none[row[~hit]])]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)], ["key", "a", "b", "times", "n_best", "count_sum"])

    rows = aligned.select(F.col(key).cast("long"), "pair_a", "pair_b", "pair_n").mapInArrow(run, "key long, a long, b long, times long, n_best long, count_sum long")
    joined = rows.join(known.filter(~near).select("a", "b", "n", "best"), ["a", "b"], "left")
    part = lambda c: F.coalesce(c, F.lit(0))
    return joined.groupBy(F.col("key").alias(key)).agg(
        F.sum(F.col("n_best") + part(F.col("times") * F.col("best").cast("int"))).alias("n_best"),
        F.sum(F.col("count_sum") + part(F.col("times") * F.col("n"))).alias("count_sum"),
    )


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of every whole text; a row for each, in no order.

    Rows that repeat a doc_id, or have none, are documents of their own, and
    each counts. The alignment is written to the shared folder once, then
    counted, then looked up.
    """
    aligned = align_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit("")).alias("groups_sha256")
    place = f"{shared_dir(spark)}/aligned-{uuid.uuid4().hex}"
    # written, the number of a row stays
    aligned.select("doc_id", *COUNTS, digest, "pair_a", "pair_b", "pair_n", F.monotonically_increasing_id().alias("row")).write.parquet(place)
    stored = spark.read.parquet(place)
    totals = link_totals(stored, cut(pair_counts(stored)), "row")
    return stored.drop("pair_a", "pair_b", "pair_n").join(totals, "row").drop("row")
