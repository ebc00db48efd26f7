"""Nearest neighbours by cross-polytope hashing.

A fast Hadamard pseudo-rotation turns a unit vector; the signed axis nearest to
the result is its hash, and a few hashes are a cell of a table. Each table has
rotations of its own. A query looks into the cells of its nearest axes in every
table, as many as a fit on true neighbours asks for, and what it finds there is
ranked by exact distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, hash_sample, table

#: Tables, and hashes that make up a vector's code in a table.
TABLES, CHAINED = 8, 2
#: Vectors of a table that one task compares at a time, on average.
BLOCK = 16_384
#: Pairs of a query and a vector whose distances are taken at a time.
PAIRS = 65_536
#: Queries whose true neighbours the number of probes is fitted to, at most, and the share of these to be found.
SAMPLE, TARGET = 128, 0.95
SEED = 17


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, scaled to keep lengths; the width is a power of 2."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def rotated(x: np.ndarray, which: int, seed: int = SEED) -> np.ndarray:
    """Unit rows after pseudo-rotation number ``which``: three rounds of random signs and a Hadamard transform."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = np.random.default_rng((seed, which)).choice([-1.0, 1.0], (3, width))
    for s in signs:
        x = hadamard(x * s)
    return x


def signed_axes(x: np.ndarray, table: int, chained: int) -> np.ndarray:
    """(chained, rows, 2 * width): coordinates along every signed axis under each hash of a table."""
    turned = [rotated(x, table * 8 + c) for c in range(chained)]
    return np.stack([np.concatenate([r, -r], axis=1) for r in turned])


def codes(x: np.ndarray, tables: int, chained: int) -> np.ndarray:
    """The code of each row in each table: its ``chained`` nearest axes as one number."""
    out = np.zeros((len(x), tables), np.int64)
    for t in range(tables):
        for near in signed_axes(x, t, chained):
            out[:, t] = out[:, t] * near.shape[1] + near.argmax(axis=1)
    return out


def probes(x: np.ndarray, tables: int, chained: int, count: int) -> np.ndarray:
    """(rows, tables, count): the codes to look into, those of the axes with the largest sums of coordinates."""
    width = 2 << max(0, (x.shape[1] - 1).bit_length())
    count = min(count, width**chained)
    out = np.zeros((len(x), tables, count), np.int64)
    for t in range(tables):
        every = signed_axes(x, t, chained)
        for row in range(len(x)):
            code, near = np.zeros(1, np.int64), np.zeros(1)
            for axis in every[:, row]:  # a sum among the largest has parts among the largest
                code = (code[:, None] * width + np.arange(width)).ravel()
                near = (near[:, None] + axis).ravel()
                if len(near) > count:
                    best = np.argpartition(-near, count - 1)[:count]
                    code, near = code[best], near[best]
            out[row, t] = code
    return out


def probes_needed(queries: np.ndarray, neighbours: np.ndarray, tables: int, chained: int) -> np.ndarray:
    """For each pair of rows the least number of probes per table with which one finds the other."""
    least = np.full(len(queries), np.iinfo(np.int64).max)
    for t in range(tables):
        asked, axis = signed_axes(queries, t, chained), signed_axes(neighbours, t, chained).argmax(axis=2)
        for row in range(len(queries)):
            reached = sum(asked[c, row, axis[c, row]] for c in range(chained))
            sums = np.zeros(1)
            for c in range(chained - 1):
                sums = (sums[:, None] + asked[c, row]).ravel()
            last = np.sort(asked[-1, row])
            better = len(last) - np.searchsorted(last, reached - sums + 1e-12, "right")
            least[row] = min(least[row], 1 + better.sum())
    return least


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) for the vectors that take part.

    Rows whose key or vector is null, vectors that are all zero or hold a null,
    NaN or infinite component, and those whose length is not the commonest one
    (the greatest, of equally common ones) take no part.
    """
    good = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter(
        F.col("id").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    common = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return good.filter(F.size("v") == F.lit(common.n if common else 0))


def _matrix(lists: list) -> np.ndarray:
    return np.array(lists, float).reshape(len(lists), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _indexed(vectors: DataFrame, tables: int, chained: int, packs: int) -> DataFrame:
    """(t, pack, codes, id, v): a vector's place in every table; the cells of a table are dealt into ``packs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = codes(_unit(_matrix(b.column(1).to_pylist())), tables, chained).ravel()
                yield _placed(b, np.repeat(np.arange(b.num_rows), tables), np.tile(np.arange(tables), b.num_rows), _pack(at, packs), at, np.arange(len(at) + 1))

    return vectors.select("id", "v").mapInArrow(run, _PLACED + vectors.schema["v"].dataType.simpleString())


def _probing(vectors: DataFrame, tables: int, chained: int, packs: int, count: int) -> DataFrame:
    """(t, pack, codes, id, v): the cells of each pack that a query looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 64):
                b = whole.slice(begin, 64)
                at = probes(_unit(_matrix(b.column(1).to_pylist())), tables, chained, count)
                row, table, _ = np.indices(at.shape).reshape(3, -1)
                code = at.ravel()
                pack = _pack(code, packs)
                order = np.lexsort((pack, table, row))
                row, table, pack, code = row[order], table[order], pack[order], code[order]
                first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(table) != 0) | (np.diff(pack) != 0)])
                yield _placed(b, row[first], table[first], pack[first], code, np.append(first, len(code)))

    return vectors.select("id", "v").mapInArrow(run, _PLACED + vectors.schema["v"].dataType.simpleString())


_PLACED = "t int, pack int, codes array<long>, id long, v "


def _pack(code: np.ndarray, packs: int) -> np.ndarray:
    return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % packs


def _placed(b: pa.RecordBatch, row: np.ndarray, table: np.ndarray, pack: np.ndarray, code: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    taken = pa.array(row)
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(code))
    return pa.RecordBatch.from_arrays([pa.array(table, pa.int32()), pa.array(pack, pa.int32()), lists, b.column(0).take(taken), b.column(1).take(taken)], ["t", "pack", "codes", "id", "v"])


def nearest_rows(x: np.ndarray, ids: np.ndarray, name: int, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the ``k`` rows of ``x`` nearest to ``v`` and their distances, ties to the smaller id; not those with id ``name``."""
    score = np.sqrt(((x - v) ** 2).sum(axis=1))
    order = np.lexsort((ids, score))
    order = order[ids[order] != name][:k]
    return order, score[order]


def _compared(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, id, score): per query the ``k`` nearest of each block that it looks into.

    A pack of cells is cut into blocks by a hash of the id, so that no task
    holds a crowded cell whole; the queries of a pack go to each of its blocks.
    A task holds one block of vectors and lets the queries pass by in batches,
    as the vectors of a block are sorted before its queries.
    """
    place = ["t", "pack"]
    blocks = cut(index.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    columns = [*place, "block", "asks", "codes", "id", "v"]
    held = index.join(blocks, place).withColumns({"block": F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), "asks": F.lit(False)})
    asked = queries.join(blocks, place).withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "asks": F.lit(True)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, block = None, [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in range(3)], axis=1)
            asks = b.column(3).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (np.diff(keys, axis=0) != 0).any(axis=1) | (np.diff(asks.astype(int)) != 0), True]) if b.num_rows else []
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if (key := tuple(keys[low])) != current:
                    current, parts, block = key, [], None
                part = b.slice(low, high - low)
                if not asks[low]:
                    parts.append(part)
                elif parts or block:
                    if block is None:
                        block, parts = _block(parts), []
                    yield from _nearest(block, part, k)

    rows = held.select(*columns).unionByName(asked.select(*columns)).repartition(*place, "block").sortWithinPartitions(*place, "block", "asks")
    return rows.mapInArrow(run, "query long, id long, score double")


def _block(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, ids and cells of a block, in order of cells."""
    whole = pa.Table.from_batches(parts)
    cell = pa.compute.list_flatten(whole.column("codes")).to_numpy()
    order = np.argsort(cell, kind="stable")
    return _matrix(whole.column("v").to_pylist())[order], whole.column("id").to_numpy()[order], cell[order]


def _nearest(block: tuple[np.ndarray, np.ndarray, np.ndarray], asked: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    """Per query the ``k`` nearest of the vectors in its cells, ties to the smaller id; ``PAIRS`` distances at a time, or one query's."""
    x, ids, cell = block
    v, names = _matrix(asked.column("v").to_pylist()), asked.column("id").to_numpy()
    lists = asked.column("codes")
    wanted, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(v)), pa.compute.list_value_length(lists).to_numpy())
    low = np.searchsorted(cell, wanted, "left")
    held = np.searchsorted(cell, wanted, "right") - low
    each = np.bincount(owner, held, len(v)).astype(np.int64)
    first = np.searchsorted(owner, np.arange(len(v) + 1))
    begin = 0
    while begin < len(v):
        end = max(begin + 1, np.searchsorted(np.cumsum(each[begin:]), PAIRS, "right") + begin)
        part = slice(first[begin], first[end])
        n = held[part]
        at = np.arange(n.sum()) + np.repeat(low[part] - np.cumsum(n) + n, n)
        query = np.repeat(owner[part], n)
        score = np.sqrt(((x[at] - v[query]) ** 2).sum(axis=1))
        order = np.lexsort((ids[at], score, query))
        place = np.arange(len(order)) - np.repeat(np.cumsum(each[begin:end]) - each[begin:end], each[begin:end])
        best = order[place < k]
        yield pa.RecordBatch.from_arrays([pa.array(names[query[best]]), pa.array(ids[at[best]]), pa.array(score[best])], ["query", "id", "score"])
        begin = end


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("score", "id")
    return found.dropDuplicates(["query", "id"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fit_probes(index: DataFrame, queries: DataFrame, k: int, tables: int = TABLES, chained: int = CHAINED, sample: int = SAMPLE, target: float = TARGET) -> int:
    """How many cells of a table a query has to look into.

    A bounded sample of the queries is compared with every vector. The answer is
    the least number with which ``target`` of their ``k`` true neighbours are in
    a cell that is looked into, whatever the size and the dimension.
    """
    some = hash_sample(queries, F.xxhash64("v"), sample, queries.count()).collect()
    if not some:
        return 1
    names, asked = np.array([r.id for r in some]), _matrix([r.v for r in some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, ids = _matrix(b.column(1).to_pylist()), b.column(0).to_numpy()
                found = [(n, *nearest_rows(x, ids, name, v, k)) for n, (name, v) in enumerate(zip(names, asked, strict=True))]
                at = pa.array(np.concatenate([f[1] for f in found]))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found])), b.column(0).take(at), pa.array(np.concatenate([f[2] for f in found])), b.column(1).take(at)], ["query", "id", "score", "v"])

    near = index.select("id", "v").mapInArrow(run, f"query long, id long, score double, v {index.schema['v'].dataType.simpleString()}")
    pairs = _top(near, k).select("query", "v").collect()  # k * sample rows at most
    if not pairs:
        return 1
    needed = probes_needed(_unit(asked[[p.query for p in pairs]]), _unit(_matrix([p.v for p in pairs])), tables, chained)
    return int(np.sort(needed)[math.ceil(target * len(needed)) - 1])


def search(vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding", tables: int = TABLES, chained: int = CHAINED, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query, by Euclidean distance.

    ``is_query`` maps the id column to a predicate. Candidates are all rows but
    those with the query's own id; rows that repeat an id count once, with their
    nearest vector. Of equal vectors only the k + 1 smallest ids can be among
    the nearest, so only these are indexed, and equal queries are searched once:
    a vector that very many rows hold costs no more than any other. How many
    cells a query looks into is fitted (``fit_probes``). A query that finds
    fewer than ``k`` looks into every cell of the first table, and so meets
    every vector. An empty table gives no rows.
    """
    rows = cut(usable(vectors, key, vector))
    copies = Window.partitionBy("v").orderBy("id")
    index = cut(rows.distinct().withColumn("n", F.row_number().over(copies)).filter(F.col("n") <= k + 1).drop("n"))
    asked = rows.filter(is_query(F.col("id"))).distinct()
    alike = asked.groupBy("v").agg(F.min("id").alias("query"))
    queries = cut(alike.select(F.col("query").alias("id"), "v"))
    packs = max(1, math.ceil(index.count() / BLOCK))
    probing = fit_probes(index, queries, k, tables, chained, target=target)
    placed = cut(_indexed(index, tables, chained, packs))
    found = cut(_top(_compared(placed, _probing(queries, tables, chained, packs, probing), k + 1), k + 1))
    # those that found too few: in the first table all vectors are in one cell or another
    enough = found.groupBy(F.col("query").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") > k).select("id")
    lacking = cut(queries.join(enough, "id", "left_anti"))
    results = found.select("query", "id", "score")
    if not lacking.isEmpty():
        first = placed.filter("t = 0").withColumn("codes", F.array(F.lit(0).cast("long")))
        every = lacking.select(F.lit(0).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(packs - 1))).alias("pack"), F.array(F.lit(0).cast("long")).alias("codes"), "id", "v")
        results = results.unionByName(_compared(first, every, k + 1))
    # a vector's row can be its query's own; that is why k + 1 were kept
    pairs = asked.select(F.col("id").alias("query_id"), "v").join(alike, "v").select("query_id", "query").join(results, "query").filter(F.col("query_id") != F.col("id"))
    best = pairs.groupBy("query_id", "id").agg(F.min("score").alias("score")).select(F.col("query_id").alias("query"), "id", "score")
    return _top(best, k).select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``search`` of every embedding whose vec_id is divisible by 100 among all others.

    Vectors that are null, zero or hold a null or non-finite component take no
    part. Ranks run from 1, nearest first, ties to the smaller vec_id.
    """
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, lambda c: c % 100 == 0, 10)
