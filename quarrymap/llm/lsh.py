"""Banded candidate search with star-shaped edges, and connected components.

Both MinHash operators bring a frame of (id, bands, sig, same): ``bands`` holds one 64-bit key a band, ``sig`` one byte
a signature value, ``same`` a hash of the whole signature. Rows of equal signatures are one: only the smallest id of
them goes into bands. All that is shuffled for those is (key, id) pairs of 16 bytes, linear in documents x bands. A
bucket's smallest id and size come from an aggregation (partial before the shuffle) that is joined back, so no task
holds a bucket; a bucket of n documents gives n - 1 edges to its smallest id. Members that fail against it are compared
with all of the bucket in tiles of about TILE x TILE documents, so m failed of n members cost m * n comparisons and
2 * m * n / TILE signatures to move.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymap.llm.kernels import from_binary_rows, segments
from quarrymap.llm.storage import mapped, release, stored

TILE = 2048


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimate from rows of signature bytes, corrected for chance agreement of one in 256."""
    same = (a == b).mean(axis=1)
    return np.maximum(0.0, (same - 1 / 256) / (1 - 1 / 256))


def _verified(edges: DataFrame, signatures: DataFrame, width: int, least: float) -> DataFrame:
    """edges (centre, id) with ok: whether the signatures agree."""
    sig = signatures.select("id", "sig")
    both = edges.join(sig, "id").select("centre", "id", F.col("sig").alias("sa")).join(sig.select(F.col("id").alias("centre"), F.col("sig").alias("sb")), "centre")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b = from_binary_rows(x.column("sa"), np.uint8, width), from_binary_rows(x.column("sb"), np.uint8, width)
            yield pa.RecordBatch.from_arrays([x.column("centre"), x.column("id"), pa.array(estimate(a, b) >= least)], ["centre", "id", "ok"])

    return mapped(both, compare, "centre long, id long, ok boolean")


def _forest(ids: np.ndarray, failed: np.ndarray, sig: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """Edges of a tile that connect each failed member with all others that it is similar to."""
    names, node = np.unique(ids, return_inverse=True)
    root = np.arange(len(names))
    other = np.flatnonzero(~failed)
    out: tuple[list[int], list[int]] = ([], [])
    for k in np.flatnonzero(failed):
        at = other[root[node[other]] != root[node[k]]]
        for j in node[at[estimate(sig[at], sig[k]) >= least]]:
            if root[j] != root[node[k]]:
                out[0].append(max(names[j], ids[k]))
                out[1].append(min(names[j], ids[k]))
                root[root == root[j]] = root[node[k]]
    return out


def _tile_edges(tiles: DataFrame, width: int, least: float) -> DataFrame:
    """Edges within the tiles (tile, failed, id, sig), which are sorted by tile within partitions."""

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        tile, failed, ids = (table.column(c).to_numpy() for c in ("tile", "failed", "id"))
        sig = from_binary_rows(table.column("sig").combine_chunks(), np.uint8, width)
        starts, _ = segments(tile)
        found = [_forest(ids[s:e], failed[s:e], sig[s:e], least) for s, e in zip(starts, [*starts[1:], len(tile)])]
        yield pa.RecordBatch.from_arrays([pa.array([x for f in found for x in f[k]], pa.int64()) for k in range(2)], ["a", "b"])

    return mapped(tiles, runs("tile", done), "a long, b long")


def runs(column: str, done: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches sorted by a column that hands ``done`` tables which end where its values do."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for x in batches:
            if not x.num_rows:
                continue
            value = x.column(column).to_numpy()
            if held and held[-1].column(column)[-1].as_py() != value[0]:
                yield from done(pa.Table.from_batches(held))
                held = []
            cut = int(np.flatnonzero(value != value[-1])[-1]) + 1 if value[0] != value[-1] else 0
            if cut:
                yield from done(pa.Table.from_batches([*held, x.slice(0, cut)]))
                held = []
            held.append(x.slice(cut))
        if held:
            yield from done(pa.Table.from_batches(held))

    return over


def similar_edges(signatures: DataFrame, width: int, least: float) -> DataFrame:
    """Edges (a, b), b < a, that connect all rows of equal signatures and all similar ones which share a band bucket.

    Each member is checked against its bucket's smallest id; those that fail are checked against all others of the
    bucket. ``signatures`` must be a stored table: it is read for the buckets and for verification.
    """
    twins = signatures.groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    equal = signatures.select("id", "same").join(twins.select("same", "first"), "same").filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    equal = stored(equal.distinct(), "equal")
    alone = signatures.join(equal.select(F.col("a").alias("id")), "id", "left_anti")
    rows = alone.select("id", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("n")).filter("n > 1")
    together = stored(rows.join(buckets, "key"), "together")
    # Buckets with the same members are one.
    members = together.groupBy("key").agg(F.expr("bit_xor(xxhash64(id))").alias("x"))
    star = together.join(members, "key").select(F.xxhash64("x", "n", "centre").alias("bucket"), "n", "centre", "id")
    star = stored(star.distinct(), "star")
    release(together)
    checked = stored(_verified(star.filter("id <> centre").select("centre", "id").distinct(), signatures, width, least), "edges")
    found = equal.unionByName(checked.filter("ok").select(F.col("id").alias("a"), F.col("centre").alias("b")))
    failed = star.filter("n > 2").join(checked.filter("not ok").select("centre", "id"), ["centre", "id"], "left_semi").select("bucket", "id", "n")
    failed = stored(failed, "failed")
    if failed.isEmpty():
        return found.distinct()
    parts = failed.groupBy("bucket").agg(F.count("*").alias("m")).select("bucket", F.ceil(F.col("m") / TILE).alias("rows"))
    others = star.filter("id <> centre").join(parts, "bucket").withColumn("columns", F.ceil(F.col("n") / TILE))
    mine = failed.join(parts, "bucket").withColumn("columns", F.ceil(F.col("n") / TILE))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    tiles = others.select("bucket", "id", F.lit(False).alias("failed"), part("columns").alias("column"), each("rows").alias("row"))
    tiles = tiles.unionByName(mine.select("bucket", "id", F.lit(True).alias("failed"), part("rows").alias("row"), each("columns").alias("column")))
    tiles = tiles.select(F.xxhash64("bucket", "row", "column").alias("tile"), "failed", "id")
    sig = signatures.select("id", "sig").dropDuplicates(["id"])
    compared = _tile_edges(tiles.join(sig, "id").repartition("tile").sortWithinPartitions("tile", "id"), width, least)
    return found.unionByName(compared).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node with an edge (a, b): root is the smallest id that can be reached.

    Alternating large-star and small-star steps (Kiveris et al., 2014) on 16-byte rows, each an aggregation that is
    joined back; every round is stored in the shared folder, and the loop ends when a round changes nothing. An empty
    frame gives none.
    """
    digest = [F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")]
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "cc")
    before = None
    while before != (state := tuple(now.agg(*digest).first())):
        before, last = state, now
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        now = stored(small, "cc")
        release(last)
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
