"""Passages that repeat anywhere in the corpus, by sorting suffixes.

A byte is removed if it lies in a string of 200 bytes that also starts
elsewhere. Not every suffix is sorted: among the 32-byte grams inside any 200
bytes the one with the smallest hash is its anchor, so equal strings have equal
anchors at equal places, and one suffix per anchor is enough. Anchors whose gram
occurs once in the corpus are left out. Sampled splitters range-partition the
others by their leading bytes; each bucket sorts its own by multikey quicksort
and compares the strings of suffixes that begin alike. Hashes only say which
strings may be equal; neighbours in their order are compared byte by byte.
Suffixes at a bucket's ends, which may go on in the next, are compared across
buckets by cryptographic digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut, small_batches, table

#: Bytes of a string that has to repeat, and of a gram.
LENGTH, GRAM = 200, 32
#: Suffixes in a bucket on average.
BUCKET = 16_000
_WORDS = GRAM // 8
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def _joined(left: np.ndarray, right: np.ndarray, level: int) -> np.ndarray:
    """Hashes of strings from those of their left and right parts."""
    x = left * _ODD[level]
    x += right
    x ^= x >> np.uint64(29)
    x *= _ODD[level - 1]
    x ^= x >> np.uint64(32)
    return x


def doubled(data: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """Hashes of all strings of each of ``sizes`` bytes, powers of 2, at every start; ``data`` has at least as many."""
    level, size, n, out = (data.astype(np.uint64) + np.uint64(1)) * _ODD[0], 1, 1, []
    while True:
        if size in sizes:
            out.append(level)
        if size == max(sizes):
            return out
        level = _joined(level[:-size], level[size:], n)
        size, n = 2 * size, n + 1


def string_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all strings of ``LENGTH`` (128 + 64 + 8) bytes; ``data`` has at least as many."""
    short, middle, long = doubled(data, 8, 64, 128)
    n = len(data) - LENGTH + 1
    return _joined(_joined(long[:n], middle[128 : 128 + n], 8), short[192 : 192 + n], 8)


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, place, first, last): each anchor and the starts of the strings that it is the anchor of.

    Every start of a string of ``LENGTH`` bytes belongs to exactly one anchor.
    Of equal hashes the leftmost counts, as that too depends on the string alone.
    """
    if len(data) < LENGTH:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    (grams,) = doubled(np.frombuffer(data, np.uint8), GRAM)
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width, size = LENGTH - GRAM + 1, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return grams[place[first]], place[first], first, np.append(first[1:], len(place)) - 1


def multikey_quicksort(words: np.ndarray, small: int = 48) -> np.ndarray:
    """The order of the rows of ``words``, compared word by word.

    Rows are split into less, equal and greater by one word of a pivot; the
    equal ones go on with the next word. Few rows are sorted directly.
    """
    order = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        low, high, depth = todo.pop()
        if high - low < 2 or depth == words.shape[1]:
            continue
        rows = order[low:high]
        if high - low <= small:
            order[low:high] = rows[np.lexsort(words[rows, depth:].T[::-1])]
            continue
        key = words[rows, depth]
        pivot = np.sort(key[[0, len(key) // 4, len(key) // 2, 3 * len(key) // 4, -1]])[2]
        less, equal, greater = (rows[m] for m in (key < pivot, key == pivot, key > pivot))
        order[low:high] = np.concatenate([less, equal, greater])
        middle, end = low + len(less), high - len(greater)
        todo += [(low, middle, depth), (middle, end, depth + 1), (end, high, depth)]
    return order


def equal_strings(flat: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Numbers that are equal for exactly those strings of ``LENGTH`` bytes, at the places ``at``, that are equal.

    Strings are put in the order of their hashes and compared with their
    neighbours, 8 bytes at a time. Where unlike strings share a hash, multikey
    quicksort puts them in their own order.
    """
    if not len(at):
        return np.zeros(0, np.int64)
    words = np.ndarray((len(flat) - 7,), "<u8", np.ascontiguousarray(flat), strides=(1,))
    order = np.argsort(hashes, kind="stable")
    alike = hashes[order[1:]] == hashes[order[:-1]]
    one, two = at[order[:-1]][alike], at[order[1:]][alike]
    same = np.ones(len(one), bool)
    for k in range(0, LENGTH, 8):
        same &= words[one + k] == words[two + k]
    group = np.cumsum(np.r_[False, ~alike])
    if not same.all():
        mixed = np.flatnonzero(np.isin(group, group[1:][alike][~same]))
        rows = words[at[order[mixed]][:, None] + np.arange(0, LENGTH, 8)].byteswap()
        own = multikey_quicksort(rows)
        number = np.empty(len(mixed), np.int64)
        number[own] = np.cumsum(np.r_[False, (rows[own[1:]] != rows[own[:-1]]).any(axis=1)])
        group[mixed] = group[-1] + 1 + number
    out = np.empty(len(at), np.int64)
    out[order] = group
    return out


def repeated_in_bucket(contexts: list[bytes], places: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, repeats, edge, digest) of the strings in a bucket's contexts that repeat or may repeat elsewhere.

    ``contexts[k]`` are the strings of suffix k in one piece, ``places`` its
    anchor therein, and ``many`` says that its document holds the piece twice.
    Strings whose suffix is like the first or the last of the bucket are at its
    edge: their like may be in another bucket, and they have a digest.
    """
    lengths = np.fromiter(map(len, contexts), np.int64, len(contexts))
    begins = np.cumsum(lengths) - lengths
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    lead = flat[(begins + places)[:, None] + np.arange(GRAM)].reshape(-1, _WORDS, 8)
    words = np.ascontiguousarray(lead).view(">u8").reshape(-1, _WORDS).astype(np.uint64)
    order = multikey_quicksort(words)
    edge = (words == words[order[0]]).all(axis=1) | (words == words[order[-1]]).all(axis=1)
    fresh = np.r_[True, (words[order[1:]] != words[order[:-1]]).any(axis=1)]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    # a suffix alone in its group has nothing like it here
    useful = np.flatnonzero(edge | many | (np.bincount(group)[group] > 1))
    counts = lengths[useful] - LENGTH + 1
    row = np.repeat(useful, counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begins[row] + start
    string = equal_strings(flat, at, string_hashes(flat)[at])
    repeats = (np.bincount(string)[string] > 1) | many[row]
    told = np.flatnonzero(repeats | edge[row])
    whole = flat.tobytes()
    # of equal strings at the edge one tells the other buckets
    first = np.zeros(len(row), bool)
    first[told[np.unique(string[told], return_index=True)[1]]] = True
    asks = edge[row] & (~repeats | first)
    digest = [hashlib.blake2b(whole[p : p + LENGTH], digest_size=16).digest() if a else None for p, a in zip(at[told].tolist(), asks[told].tolist(), strict=True)]
    return row[told], start[told], repeats[told], edge[row[told]], digest


def text_key(text: Column) -> Column:
    """128 bits of a text's SHA-256, the name of all documents with that text; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def _gram_places(texts: DataFrame) -> DataFrame:
    """(gram, text, place) of every anchor; ``text`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [anchors(t.encode()) for t in b.column(1).to_pylist()]
            sizes = [len(f[0]) for f in found]
            if sum(sizes):
                grams, places = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), b.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(places)], ["gram", "text", "place"])

    return texts.select("hash", "text").mapInArrow(run, "gram long, text long, place long")


def _contexts(texts: DataFrame) -> DataFrame:
    """(lead, context, place, key, starts) of the anchors at ``places`` of each text.

    A context that a text holds several times is one row with all its starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"lead": [], "context": [], "place": [], "key": [], "starts": []}
            for key, text, wanted in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                data, pieces = text.encode(), {}
                _, place, first, last = anchors(data)
                for k in np.flatnonzero(np.isin(place, wanted)):
                    low = int(first[k])
                    pieces.setdefault((data[low : last[k] + LENGTH], int(place[k]) - low), []).append(low)
                for (piece, at), starts in pieces.items():
                    for name, value in zip(out, (piece[at : at + GRAM], piece, at, key, starts), strict=True):
                        out[name].append(value)
            if out["key"]:
                kinds = (pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return texts.select("key", "text", "places").mapInArrow(run, "lead binary, context binary, place int, key binary, starts array<long>")


def _compared(suffixes: DataFrame) -> DataFrame:
    """Rows (key, low, high, digest, state) from each bucket.

    State 1: the bytes low to high repeat. State 0: the string at low was found
    once, at an end of its bucket, and the other buckets have to be asked. State
    2: ``digest`` belongs to a string that repeats at an end of a bucket, for
    the others that ask; it has no place.
    """
    schema = pa.schema([("lead", pa.binary()), ("context", pa.binary()), ("place", pa.int32()), ("key", pa.binary()), ("starts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), schema).combine_chunks()
        if not rows.num_rows:
            return
        starts = rows.column("starts").to_pylist()
        many = np.fromiter((len(s) > 1 for s in starts), bool, len(starts))
        row, at, repeats, edge, digest = repeated_in_bucket(rows.column("context").to_pylist(), rows.column("place").to_numpy().astype(np.int64), many)
        keys = rows.column("key").combine_chunks()
        # runs of neighbouring repeats of a suffix become one span, once for each of its starts
        r, p = row[repeats], at[repeats]
        fresh = np.flatnonzero(np.r_[True, (np.diff(r) != 0) | (np.diff(p) != 1)]) if len(r) else np.zeros(0, int)
        last = np.append(fresh[1:], len(r)) - 1 if len(r) else fresh
        spans = [(k, s + p[f], s + p[e] + LENGTH) for k, f, e in zip(r[fresh], fresh, last, strict=True) for s in starts[k]]
        asks = ~repeats
        single = np.fromiter((starts[k][0] for k in row[asks]), np.int64, int(asks.sum())) + at[asks]
        tells = [digest[k] for k in np.flatnonzero(repeats & edge) if digest[k]]
        n, m, t = len(spans), len(single), len(tells)
        if n + m + t:
            place = np.array([x[1:] for x in spans], np.int64).reshape(-1, 2)
            owner = pa.array(np.concatenate([np.array([x[0] for x in spans], np.int64), row[asks], np.zeros(t, np.int64)]), mask=np.arange(n + m + t) >= n + m)
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(owner),
                    pa.array(np.concatenate([place[:, 0], single, np.zeros(t, np.int64)])),
                    pa.array(np.concatenate([place[:, 1], single + LENGTH, np.zeros(t, np.int64)])),
                    pa.array([None] * n + [digest[k] for k in np.flatnonzero(asks)] + tells, pa.binary()),
                    pa.array(np.repeat(np.array([1, 0, 2], np.int32), [n, m, t])),
                ],
                ["key", "low", "high", "digest", "state"],
            )

    return suffixes.mapInArrow(run, "key binary, low long, high long, digest binary, state int")


def repeated_spans(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(key, spans): for texts that occur once, the sorted byte spans that repeat elsewhere; ``key`` is ``text_key``.

    Only one document per text takes part, so copies don't count here. No text
    is shuffled unless it shares an anchor with another place.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(row_id).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter(F.octet_length("text") >= LENGTH)
    hashed = own.withColumn("hash", F.xxhash64("text"))
    grams = _gram_places(hashed)
    at = F.xxhash64("text", "place")
    shared = grams.groupBy("gram").agg(F.min(at).alias("low"), F.max(at).alias("high")).filter("low <> high").select("gram")
    # written first: so a broadcast can take them if they are few, or else a join that splits hot grams
    places = cut(grams.join(bounded_broadcast(shared), "gram", "left_semi").groupBy("text").agg(F.collect_set("place").alias("places")))
    # of the rows with one text that with the smallest id is read; rows that repeat it too do no harm
    wanted = bounded_broadcast(places.select(F.col("text").alias("chosen")))
    some = hashed.join(wanted, hashed.hash == wanted.chosen, "left_semi").withColumn("key", text_key(F.col("text")))
    first = some.groupBy("key", "hash").agg(F.min("row").alias("least"))
    chosen = first.join(places.withColumnRenamed("text", "of"), F.col("hash") == F.col("of")).select(F.col("key").alias("chosen"), "least", "places")
    read = some.join(chosen, (F.col("key") == F.col("chosen")) & F.col("row").eqNullSafe(F.col("least")))
    contexts = _contexts(read.select("key", "text", "places"))
    buckets = 1 + (places.agg(F.sum(F.size("places"))).first()[0] or 0) // BUCKET
    compared = cut(_compared(contexts.repartitionByRange(buckets, "lead", F.xxhash64("key", "place", "starts"))))
    asked = compared.filter("state = 0")
    told = compared.filter("state <> 1").groupBy("digest").agg(F.sum(F.when(F.col("state") == 0, 1).otherwise(2)).alias("n")).filter("n > 1").select("digest")
    spans = compared.filter("state = 1").select("key", "low", "high").union(asked.join(told, "digest", "left_semi").select("key", "low", "high"))
    return spans.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans as maximal runs."""
    out: list[list[int]] = []
    for low, high in spans:
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(low, high) for low, high in out]


def kept_bytes(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for low, high in runs:
        parts.append(data[at:low])
        at = high
    return b"".join([*parts, data[at:]])


def whole_characters(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without the characters that they cut."""
    out = []
    for low, high in runs:
        while low < high and data[low] & 0xC0 == 0x80:
            low += 1
        while high > low and high < len(data) and data[high] & 0xC0 == 0x80:
            high -= 1
        if low < high:
            out.append((low, high))
    return out


ADDED = "_n_bytes long, _n_removed long, _n_spans long, _kept_sha256 string, _kept string"


def without_repeats(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``docs`` with _n_bytes, _n_removed, _n_spans, _kept_sha256 and _kept (the text that is left), which replace columns of these names.

    The first four count bytes. ``_kept`` has whole characters only: a character
    that a removed run cuts stays. Null texts count as empty and stay null. A
    text that occurs more than once goes entirely if it has 200 bytes. A shorter
    one has nothing to remove.
    """
    small_batches(docs.sparkSession)
    added = [x.split()[0] for x in ADDED.split(", ")]
    columns = [c for c in docs.columns if c not in added]
    # all columns but the text travel as one, so that none can clash with those used here
    rest = F.struct(*(F.col(f"`{c}`") for c in columns if c != text), F.lit(0).alias("_")).alias("rest")
    keyed = docs.select(rest, F.col(f"`{text}`").alias("text"), text_key(F.col(f"`{text}`")).alias("key"))
    filled = F.coalesce("text", F.lit(""))
    copies = keyed.filter(F.octet_length(filled) >= LENGTH).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    spans = repeated_spans(docs, text, row_id).join(copies, "key", "left_anti")
    removed = cut(spans.unionByName(copies.select("key", F.lit(None).cast("array<struct<low:bigint,high:bigint>>").alias("spans"))))
    touched = bounded_broadcast(removed.select("key"))
    size, none = F.octet_length(filled).cast("long"), F.lit(0).cast("long")
    same = keyed.join(touched, "key", "left_anti").select("rest", "text", size, none, none, F.sha2(filled.cast("binary"), 256), F.col("text")).toDF("rest", "text", *added)
    changed = _cut_out(keyed.join(touched, "key", "left_semi").join(removed, "key").select("rest", "text", "spans"))
    shown = [F.col("text").alias(c) if c == text else F.col(f"rest.`{c}`") for c in columns]
    return same.unionByName(changed).select(*shown, *added)


def _cut_out(changed: DataFrame) -> DataFrame:
    """(rest, text, ``ADDED``) from (rest, text, spans); NULL spans take the whole text."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    added = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ADDED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = (t or "").encode()
                runs = [(0, len(data))] if spans is None else merged([(s["low"], s["high"]) for s in spans])
                left = kept_bytes(data, runs)
                rows.append((len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest(), kept_bytes(data, whole_characters(data, runs)).decode()))
            made = zip(*rows, strict=True) if rows else [[]] * len(added)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *(pa.array(list(c), f.type) for c, f in zip(made, added, strict=True))], ["rest", "text", *added.names])

    schema = changed.select("rest", "text").schema
    for name, kind in (x.split() for x in ADDED.split(", ")):
        schema = schema.add(name, kind)
    return changed.mapInArrow(run, schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated strings of 200 bytes; a row for each, in no order.

    A null text has no bytes. Rows that repeat a text, or a doc_id, are documents of their own.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", *(F.col(f"_{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of text, and n_chars recounted; other columns pass through."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_row")
    columns = [F.col("_kept").alias("text") if c == "text" else F.length("_kept").cast("long").alias(c) if c == "n_chars" else F.col(f"_row.`{c}`") for c in docs.columns]
    return without_repeats(docs.select("doc_id", "text", row)).select(*columns)
