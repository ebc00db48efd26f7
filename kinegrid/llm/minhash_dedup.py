"""Near-duplicate documents by b-bit MinHash and a multi-index Hamming join.

A document's signature has 90 components of b bits, and the distance of two is
the number of components that differ. The signature is split into 18 chunks of
5 components. Signatures within 35 of each other differ by at most one
component in some chunk (pigeonhole: 18 chunks with two or more would make 36).
So every chunk is filed once for each of its components that may differ, under
the other four; whoever shares such a key is a candidate, and no pair within
the distance is missed. Candidates are confirmed on their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut, small_batches, table

COMPONENTS, CHUNK, BITS = 90, 5, 16
#: The greatest distance that the chunks guarantee. Pairs beyond it meet if they share a bucket all the same: of pairs
#: at a similarity of 0.8 all but 3.6e-11 do, that is (1 - 0.8 ** 5 - 5 * 0.2 * 0.8 ** 4) ** 18.
RADIUS = 2 * (COMPONENTS // CHUNK) - 1
#: Pairs at a greater distance are not confirmed: a pair at a similarity of 0.8 exceeds it with a chance of 5.1e-11.
FAR = 45
SEED = 29
#: Shingles that meet all components at once in memory.
BLOCK = 4096
#: Bytes of the full sets of a block of documents, two of which meet in a task.
BLOCK_BYTES = 1_000_000
#: Links that a task holds before it joins their components.
PENDING = 50_000
#: Ids or links that a task takes where they are few beside the documents.
ROWS = 50_000


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CONSTANTS = mix64(np.arange(1, 2 * COMPONENTS + 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED))
_MULTIPLIERS, _OFFSETS, _PLACES = _CONSTANTS[:COMPONENTS] | np.uint64(1), _CONSTANTS[COMPONENTS : 2 * COMPONENTS], _CONSTANTS[2 * COMPONENTS :] | np.uint64(1)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The sorted set of 64-bit hashes of all ``width``-word shingles of a whole text.

    A-Z are lower-cased; words are runs other than ASCII white space, which is
    what bytes.lower() and bytes.split() do. A text of fewer words is one
    shingle; one without words has none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(len(words) - width + 1, 1)
    total = np.full(n, min(len(words), width), np.uint64)
    for k in range(min(width, len(words))):
        total = mix64((total ^ hashed[k : k + n]) * _PLACES[k % len(_PLACES)] + np.uint64(k + 1))
    return np.unique(total)


def signature(shingles: np.ndarray) -> np.ndarray:
    """``COMPONENTS`` minima under as many hash functions, ``BITS`` bits of each."""
    low = np.full(COMPONENTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        part = shingles[at : at + BLOCK, None] * _MULTIPLIERS + _OFFSETS
        part ^= part >> np.uint64(32)
        part *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(low, part.min(axis=0), out=low)
    return (mix64(low) >> np.uint64(64 - BITS)).astype(np.uint16)


def set_id(shingles: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def class_id(set_hash: bytes) -> int:
    """Half of a set's hash, as a signed number: the name of the class of documents with that set."""
    return int.from_bytes(set_hash[:8], "big", signed=True)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """(rows, COMPONENTS): for each component the key of its chunk without it."""
    s = signatures.astype(np.uint64).reshape(len(signatures), -1, CHUNK)
    out = np.empty_like(s)
    for left_out in range(CHUNK):
        key = np.arange(s.shape[1], dtype=np.uint64)[None, :] * np.uint64(CHUNK) + np.uint64(left_out + 1)
        for k in range(CHUNK):
            if k != left_out:
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) ^ s[:, :, k])
        out[:, :, left_out] = key
    return out.reshape(len(signatures), -1)


def with_signatures(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, set, sig) from one pass over the texts; ``set`` and ``sig`` are null without shingles."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_hashes(t, width) for t in b.column(1).to_pylist()]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            ids = pa.array([set_id(s) if len(s) else None for s in sets], pa.binary())
            sigs = pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, ids, sigs], [key, "n_shingles", "set", "sig"])

    selected = docs.select(key, text)
    return selected.mapInArrow(run, f"{key} {selected.schema[key].dataType.simpleString()}, n_shingles long, set binary, sig binary")


def bucket_keys(sets: DataFrame) -> DataFrame:
    """(bucket, id): every document class under its ``COMPONENTS`` keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = chunk_keys(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(b.num_rows, COMPONENTS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), COMPONENTS)))], ["bucket", "id"])

    return sets.select("id", "sig").mapInArrow(run, "bucket long, id long")


def not_far(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (x, y) whose signatures differ in at most ``FAR`` components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, COMPONENTS) for k in (2, 3))
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["x", "y"]).filter(pa.array((one != two).sum(axis=1) <= FAR))

    one, two = (sigs.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "xy")
    return pairs.join(one, "x").join(two, "y").select("x", "y", "sig_x", "sig_y").mapInArrow(run, "x long, y long")


def confirmed(pairs: DataFrame, keys: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (x, y) with 100 * intersection >= percent * union of the full shingle sets.

    ``keys`` has the (id, key) of a document of each class, and ``texts`` the
    (key, text) of all documents. Only sets of documents in some pair move.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["x", "y"]).filter(pa.array(keep, pa.bool_()))

    def side(c: str) -> DataFrame:
        return _sets(texts, pairs.select(F.col(c).alias("id")).distinct().join(keys, "id"), width).select(F.col("id").alias(c), F.col("s").alias(f"s_{c}"))

    return pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "s_x", "s_y").mapInArrow(compare, "x long, y long")


def _sets(texts: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """(id, s): the shingle set of each document with one of ``keys`` (key), under its class, which follows from the set.

    No text is shuffled unless the keys are too many to broadcast.
    """

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for t in b.column(0).to_pylist() if len(s := shingle_hashes(t, width))]
            yield pa.RecordBatch.from_pydict({"id": pa.array([class_id(set_id(s)) for s in sets], pa.int64()), "s": pa.array([s.tobytes() for s in sets], pa.binary())})

    wanted = bounded_broadcast(keys.select("key").distinct())
    return texts.join(wanted, "key", "left_semi").select("text").mapInArrow(shingled, "id long, s binary")


def smallest_reached(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 to n - 1 the smallest that it reaches over the links between ``u`` and ``v``."""
    label = np.arange(n)
    while len(u):
        near = np.minimum(label[u], label[v])
        after = label.copy()
        np.minimum.at(after, u, near)
        np.minimum.at(after, v, near)
        after = after[after]
        if (after == label).all():
            break
        label = after
    return label


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what (x, y) connect, one for each id but the smallest of its component, which it leads to."""
    names, ends = np.unique(np.stack([x, y]), return_inverse=True)
    u, v = ends.reshape(2, -1)
    label = smallest_reached(u, v, len(names))
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]


def components(links: DataFrame) -> DataFrame:
    """(id, component): for each id in ``links`` (x, y) the smallest id that it reaches.

    Each task first reduces its share of the links to a forest. Then, each
    round, an id takes the smallest label among itself and its neighbours, and
    the label of that label, so that chains halve. Labels are written each
    round. They only ever decrease, so the rounds end when their sum stays. Ids
    are few beside documents, so a task takes ``ROWS`` of them, however many
    partitions a shuffle has.
    """
    links = cut(links.select("x", "y").filter("x <> y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches), pa.schema([("x", pa.int64()), ("y", pa.int64())]))
        if whole.num_rows:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, forest(whole.column(0).to_numpy(), whole.column(1).to_numpy()))), ["x", "y"])

    trees = cut(links.coalesce(1 + links.count() // ROWS).mapInArrow(run, "x long, y long"))
    tasks = 1 + 2 * trees.count() // ROWS
    edges = trees.coalesce(tasks)
    edges = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    labels = cut(edges.groupBy(F.col("x").alias("id")).agg(F.least(F.first("x"), F.min("y")).alias("component")).coalesce(tasks))
    before = None
    while (after := labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]) != before:
        heard = edges.join(labels, edges.y == labels.id).select(F.col("x").alias("id"), "component").coalesce(tasks)
        near = labels.union(heard).groupBy("id").agg(F.min("component").alias("near")).coalesce(tasks)
        jump = labels.select(F.col("id").alias("key"), "component")
        labels = cut(near.join(jump, F.col("near") == F.col("key")).select("id", "component").coalesce(tasks))
        before = after
    return labels


def _crowded(classes: DataFrame) -> DataFrame:
    """(bucket, id) for the buckets with several classes."""
    filed = bucket_keys(classes)
    several = filed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    return filed.join(bounded_broadcast(several), "bucket").select("bucket", "id")


def linked_classes(classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, component) for the classes (id, key, sig) that link with another one.

    Buckets can be large, so their members don't all meet. First each meets its
    bucket's hub, and confirmed pairs make components: a group of alike
    documents costs a few pairs for each of its members. Only pairs of a bucket
    in different components can matter after that, and of these only members
    that share enough of their shingles with others to link with any.
    ``_links_in_blocks`` compares those in full.
    """
    members = cut(_crowded(classes))
    tasks = 1 + members.count() // ROWS
    members = members.coalesce(tasks)
    keys = classes.select("id", "key")
    # ids are hashes, so the smallest of a bucket is any of its members, and often the same in buckets that share members
    hubs = members.groupBy("bucket").agg(F.min("id").alias("hub"))
    star = members.join(hubs, "bucket").filter("id <> hub").select(F.col("id").alias("x"), F.col("hub").alias("y")).distinct()
    met = cut(not_far(star.coalesce(tasks), classes))
    labels = components(confirmed(met, keys, texts, width, percent))
    placed = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")).select("bucket", "id", "component").coalesce(tasks)
    open_ = cut(_mixed(placed).coalesce(tasks))
    able = cut(_able(open_.select("id").distinct().join(classes.select("id", "key", "n_shingles"), "id"), texts, width, percent))
    left = cut(_mixed(open_.drop("first").join(able, "id")).coalesce(tasks))
    bridges = _links_in_blocks(left, keys, texts, width, percent)
    merged = components(bridges).select(F.col("id").alias("component"), F.col("component").alias("merged"))
    known = labels.unionByName(left.select("id", "component").distinct()).distinct()
    return known.join(merged, "component", "left").select("id", F.coalesce("merged", "component").alias("component"))


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows of ``placed`` in buckets with several components, with the ``first`` id of the bucket."""
    several = placed.groupBy("bucket").agg(F.min("id").alias("first"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    return placed.join(several.select("bucket", "first"), "bucket")


def _able(some: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, n_shingles) of the classes in ``some`` of whose shingles others in it hold ``percent`` %: the rest can't link with any."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s) // 8, k, np.int64)), pa.array(np.frombuffer(s, np.int64))], ["id", "shingle"])

    held = _sets(texts, some, width).mapInArrow(listed, "id long, shingle long")
    alone = held.groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("last")).filter("id = last").groupBy("id").agg(F.count("*").alias("alone"))
    own = F.coalesce("alone", F.lit(0))
    return some.join(alone, "id", "left").filter(100 * (F.col("n_shingles") - own) >= percent * F.col("n_shingles")).select("id", "n_shingles")


def _links_in_blocks(left: DataFrame, keys: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(x, y): links between components in ``left`` (bucket, first, id, component, n_shingles), no more than it takes to join them.

    Buckets that share members form a cluster. Its documents are dealt into
    blocks of ``BLOCK_BYTES`` of shingles by a hash, those of its largest
    component into blocks of their own, which needn't meet each other. A task
    holds two blocks; only links between components leave it.
    """
    clusters = components(left.select(F.col("first").alias("x"), F.col("id").alias("y"))).withColumnRenamed("component", "cluster")
    docs = cut(left.select("id", "component", "n_shingles").distinct().join(clusters, "id"))
    parts = docs.groupBy("cluster", "component").agg(F.sum(8 * F.col("n_shingles")).alias("bytes"))
    sizes = parts.groupBy("cluster").agg(F.max(F.struct("bytes", "component")).alias("major"), F.sum("bytes").alias("bytes"))
    blocks = lambda c: F.ceil(c / BLOCK_BYTES).cast("int")
    minor, every = F.col("minor"), F.col("minor") + F.col("majors")
    dealt = (
        docs.join(sizes.select("cluster", F.col("major.component").alias("largest"), blocks(F.col("bytes") - F.col("major.bytes")).alias("minor"), blocks(F.col("major.bytes")).alias("majors")), "cluster")
        .withColumn("block", F.when(F.col("component") == F.col("largest"), minor + F.pmod(F.xxhash64("id"), F.col("majors"))).otherwise(F.pmod(F.xxhash64("id"), minor)).cast("int"))
        .join(keys, "id")
    )
    dealt = cut(dealt.select("id", "key", "component", "cluster", "block", minor.alias("minor"), every.alias("every")))
    others = F.filter(F.sequence(F.lit(0), F.col("every") - 1), lambda o: (F.col("block") < F.col("minor")) | (o < F.col("minor")))
    rows = (
        dealt.join(_sets(texts, dealt, width), "id")
        .select("id", "component", "cluster", "block", "s", F.explode(others).alias("other"))
        .select("id", "component", "cluster", "s", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).alias("upper"))
    )

    def compare(group: pa.Table) -> pa.Table:
        found = _bridges(group.column("s").to_pylist(), group.column("component").to_numpy(), group.column("upper").to_numpy(), group.column("low")[0].as_py() == group.column("high")[0].as_py(), percent)
        return pa.table({"x": pa.array(found[0], pa.int64()), "y": pa.array(found[1], pa.int64())})

    return rows.groupBy("cluster", "low", "high").applyInArrow(compare, "x long, y long")


def _bridges(sets: list[bytes], component: np.ndarray, upper: np.ndarray, one_block: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, y): components, each with the smallest that it reaches over links of two blocks, or inside one.

    What a document of one block shares with each of the other is counted along
    the sorted shingles of the other.
    """
    sizes = np.fromiter((len(s) // 8 for s in sets), np.int64, len(sets))
    ones = np.arange(len(sets)) if one_block else np.flatnonzero(~upper)
    twos = ones if one_block else np.flatnonzero(upper)
    none = np.zeros(0, np.int64)
    if not len(ones) or not len(twos):
        return none, none
    held = np.frombuffer(b"".join(sets[k] for k in ones), np.uint64)
    order = np.argsort(held, kind="stable")
    holder, held = np.repeat(np.arange(len(ones)), sizes[ones])[order], held[order]
    names, local = np.unique(component, return_inverse=True)
    label = np.arange(len(names))
    found: list[np.ndarray] = []
    waiting = 0
    for at in twos:
        s = np.frombuffer(sets[at], np.uint64)
        low, times = np.searchsorted(held, s, "left"), np.searchsorted(held, s, "right")
        times -= low
        places = np.arange(times.sum()) + np.repeat(low - np.cumsum(times) + times, times)
        shared = np.bincount(holder[places], minlength=len(ones))
        hit = local[ones[100 * shared >= percent * (sizes[ones] + sizes[at] - shared)]]
        hit = np.unique(hit[label[hit] != label[local[at]]])
        found.append(np.stack([hit, np.full(len(hit), local[at])]))
        waiting += len(hit)
        if waiting > PENDING or at == twos[-1]:
            u, v = np.concatenate([np.stack([np.arange(len(names)), label]), *found], axis=1)
            label, found, waiting = smallest_reached(u, v, len(names)), [], 0
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of ``docs``.

    Rows link with 100 * intersection >= percent * union of their sets of
    ``width``-word shingles; component_id is the smallest key that a row
    reaches, itself included, and kept says that it is the row's own. A text
    without words has no shingles and links with nothing. Rows that share a key
    are documents of their own, and rows that repeat one have the same result.
    A row without a key is not linked; its component is null, and it is kept.
    """
    own = F.col(key).cast("long")
    signed = cut(with_signatures(docs, width, key, text))
    classes = _classes(signed.withColumn("_own", own))
    placed = classes.join(linked_classes(classes, docs.select(own.alias("key"), F.col(text).alias("text")), width, percent), "id")
    smallest = placed.groupBy("component").agg(F.min("key").alias("component_id"))
    joined = placed.join(smallest, "component").select("id", "component_id")
    # other sets have one row, which is a component of its own
    found = classes.join(joined, "id", "left").filter("component_id is not null or copies > 1").select(F.col("set").alias("_set"), F.coalesce("component_id", "key").alias("component_id"))
    out = signed.join(bounded_broadcast(found), (F.col("set") == F.col("_set")) & own.isNotNull(), "left").withColumn("component_id", F.coalesce("component_id", own))
    return out.select(key, "n_shingles", "component_id", F.col("component_id").eqNullSafe(own).alias("kept"))


def _classes(signed: DataFrame) -> DataFrame:
    """(id, key, set, sig, n_shingles, copies) for every set of rows (_own, n_shingles, set, sig) with a key ``_own``; the key is the smallest."""
    sets = signed.filter(F.col("set").isNotNull() & F.col("_own").isNotNull())
    named = F.conv(F.hex(F.substring("set", 1, 8)), 16, -10).cast("long")
    # equal sets are one class; only its row goes on, however many copies there are
    one = sets.groupBy("set").agg(F.min("_own").alias("key"), F.min("sig").alias("sig"), F.min("n_shingles").alias("n_shingles"), F.count("*").alias("copies"))
    return cut(one.select(named.alias("id"), "key", "set", "sig", "n_shingles", "copies"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_duplicates`` of all documents by sets of 4-word shingles at 80 %; a row for each, in no order.

    Null and empty texts have no shingles and link with nothing. Of rows that
    repeat a doc_id each counts as a document; a null doc_id is linked with none.
    """
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=80)


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of linked rows: that with the smallest doc_id, null last.

    Every row is a document of its own, also one without a doc_id or with that
    of another row. Among rows that repeat a doc_id a hash of all columns
    decides, and of rows that are equal in all columns one stays. Texts without
    words link with nothing, so their rows all stay.
    """
    words = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    others = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")))
    row = F.substring(F.unhex(F.sha2(F.concat(words, others).cast("binary"), 256)), 1, 16)
    # the operators' keys have to be known for every row, so the text gives them
    own = F.xxhash64("text")
    signed = cut(with_signatures(docs.select(F.struct("doc_id", row.alias("row"), own.alias("own")).alias("_id"), "text"), width, "_id"))
    classes = _classes(signed.withColumn("_own", F.col("_id.own")))
    linked = linked_classes(classes, docs.select(own.alias("key"), "text"), width, percent)
    placed = classes.join(linked, "id", "left").select("set", F.coalesce("component", "id").alias("component"))
    rows = signed.filter("set is not null").groupBy("set", "_id").agg(F.count("*").alias("n"))
    first = rows.groupBy("set").agg(F.min(F.struct(F.col("_id.doc_id").isNull().alias("unnamed"), F.col("_id.doc_id").alias("doc_id"), F.col("_id.row").alias("row"), "n")).alias("f"))
    chosen = first.join(placed, "set").groupBy("component").agg(F.min("f").alias("f")).select("f.row", "f.n")
    wordless = signed.filter("set is null").select("_id.row", F.lit(1).cast("long").alias("n")).distinct()
    kept = cut(chosen.union(wordless).select(F.col("row").alias("_kept"), "n"))
    keyed = docs.withColumn("_row", row)
    once = keyed.join(kept.filter("n = 1").select("_kept"), F.col("_row") == F.col("_kept"), "left_semi").drop("_row")
    repeated = kept.filter("n > 1").select("_kept")
    if repeated.isEmpty():
        return once
    return once.unionByName(keyed.join(bounded_broadcast(repeated), F.col("_row") == F.col("_kept"), "left_semi").dropDuplicates(["_row"]).drop("_row"))
