"""Nearest neighbours: an inverted file with product-quantised residuals.

Coarse centroids cut the vectors into lists; what is left of a vector beyond its centroid is coded as one of 256
centroids in each of PARTS subspaces. Both are fitted by k-means on a sample of about FIT vectors (at most FIT_BYTES);
every vector is indexed. A query probes its nearest lists; in each, a table of distances from its residual to every code
gives approximate distances by look-up (asymmetric), and all that can be among the nearest are reranked by their exact
distance: the approximate one is off by at most how far a vector lies from its code. How many lists are probed is
measured: SAMPLE vectors are searched exhaustively, and the probes are what covers the share TARGET of their true
neighbours (few lists where vectors cluster, many where they don't).

Lists lie in cells of about CELL vectors: small lists share one, a large one is cut into several. Each vector is in one
cell and never copied; a query is sent to the cells of its lists. Cells are sorted with their vectors first, so a task
holds the vectors of one cell and queries stream past. Equal vectors are searched as one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymap.llm import kernels as K
from quarrymap.llm.storage import mapped, stored

NEIGHBOURS = 10
#: The queries are the vectors whose id this divides.
EVERY = 50
PARTS, CODES = 16, 256
FIT, FIT_BYTES, FINE_FIT = 131072, 64 << 20, 16384
SAMPLE, TARGET = 200, 0.97
#: Candidates of each probed list whose exact distances give the first bound for the others.
RERANKED = 30
COARSE_ROUNDS, FINE_ROUNDS = 6, 5
#: The number of lists is the root of the number of vectors up to here: the size of the model.
MOST_LISTS = 4096
CELL = 4096
_BLOCK = 256
#: Exact distances that are held at once.
_EXACT = 1 << 16


def _usable(vectors: DataFrame) -> DataFrame:
    """id, vec (float32 bytes): one row an id; ids, vectors and values that are null or not finite are left out, and lengths but the most frequent."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    rows = rows.filter(F.size("v") == (widths["w"] if widths else -1)).groupBy("id").agg(F.min("v").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                flat = x.column("v").flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([x.column("id"), K.binary_rows((flat + 0).astype(np.float32).reshape(x.num_rows, -1))], ["id", "vec"])

    return mapped(rows, pack, "id long, vec binary")


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    norms, out = (centres**2).sum(axis=1), np.empty(len(x), np.int64)
    for lo in range(0, len(x), 2048):
        out[lo : lo + 2048] = (norms - 2 * (x[lo : lo + 2048] @ centres.T)).argmin(axis=1)
    return out


def _kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centres of the rows, which start at the first k; one that gets none stays."""
    centres = x[:k].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres).astype(np.float32)
    return centres


class Index(NamedTuple):
    coarse: np.ndarray  # lists x width
    books: np.ndarray  # parts x CODES x width of a part

    def split(self, residual: np.ndarray) -> np.ndarray:
        """rows x parts x width of a part, padded with zeros."""
        parts, _, w = self.books.shape
        return np.pad(residual, ((0, 0), (0, parts * w - residual.shape[1]))).reshape(len(residual), parts, w)


def fitted(x: np.ndarray, lists: int) -> Index:
    """The index of a sample in random order."""
    coarse = _kmeans(x, min(lists, len(x)), COARSE_ROUNDS)
    parts = min(PARTS, x.shape[1])
    w = -(-x.shape[1] // parts)
    some = x[:FINE_FIT]
    rest = np.pad(some - coarse[nearest(some, coarse)], ((0, 0), (0, parts * w - x.shape[1])))
    books = np.stack([_kmeans(np.ascontiguousarray(rest[:, m * w : (m + 1) * w]), min(CODES, len(some)), FINE_ROUNDS) for m in range(parts)])
    return Index(coarse, books)


class Layout(NamedTuple):
    """Which cells a list is in: those of its group, first to first + parts - 1."""

    group: np.ndarray  # of each list
    first: np.ndarray  # of each group
    parts: np.ndarray  # of each group


def laid_out(coarse: np.ndarray, sizes: np.ndarray) -> Layout:
    """Neighbouring lists share a group up to CELL vectors; a larger list is a group of several cells."""
    middle = _kmeans(coarse[np.random.default_rng(5).permutation(len(coarse))], max(1, min(len(coarse), math.ceil(sizes.sum() / CELL))), 5)
    group, parts, held = np.empty(len(coarse), np.int64), [], CELL + 1
    for at in np.argsort(nearest(coarse, middle), kind="stable"):
        if held + sizes[at] > CELL:
            parts.append(max(1, -(-int(sizes[at]) // CELL)))
            held = 0
        held += sizes[at]
        group[at] = len(parts) - 1
    return Layout(group, np.cumsum([0, *parts[:-1]]), np.array(parts))


class Listed:
    """The vectors of one list in a cell, prepared for search."""

    def __init__(self, index: Index, at: int, ids: np.ndarray, codes: np.ndarray, vectors: np.ndarray):
        self.centre, self.books, self.ids, self.codes, self.vectors = index.coarse[at], index.books, ids, codes, vectors
        coded = index.books[np.arange(len(index.books)), codes].reshape(len(ids), -1)
        rest = index.split(vectors - self.centre).reshape(len(ids), -1)
        #: How far each vector is from its code, and the squared norm of the code.
        self.error, self.norm = np.sqrt(((rest - coded) ** 2).sum(axis=1)), (coded**2).sum(axis=1)
        self.book_norms = (index.books**2).sum(axis=2)

    def approximate(self, residual: np.ndarray) -> np.ndarray:
        """Squared distances of the queries' residuals (rows x parts x width) to all codes, by look-up."""
        near = np.zeros((len(residual), len(self.ids)), np.float32)
        for m in range(residual.shape[1]):
            part = residual[:, m]
            table = self.book_norms[m] - 2 * (part @ self.books[m].T) + (part**2).sum(axis=1, keepdims=True)
            near += table[:, self.codes[:, m]]
        return near

    def exact(self, queries: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(row), np.float32)
        for lo in range(0, len(row), _EXACT):
            to = slice(lo, lo + _EXACT)
            out[to] = ((self.vectors[at[to]] - queries[row[to]]) ** 2).sum(axis=1)
        return out

    def search(self, index: Index, q: np.ndarray, k: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances) of the k best for each query, equal ones by id; -1 where there are fewer. What is farther than ``reach`` may be left out."""
        found, far = np.full((len(q), k), -1, np.int64), np.full((len(q), k), np.inf, np.float32)
        residual = index.split(q - self.centre)
        near = self.approximate(residual)
        r = min(RERANKED, len(self.ids))
        best = np.argpartition(near, r - 1, axis=1)[:, :r]
        exact = self.exact(q, np.repeat(np.arange(len(q)), r), best.ravel()).reshape(best.shape)
        bound = np.minimum(reach, np.partition(exact, k - 1, axis=1)[:, k - 1] if r >= k else np.inf)
        # No exact distance is below the approximate one less the error; rounding gets its share.
        slack = np.float32(1e-5) * ((residual**2).sum(axis=(1, 2))[:, None] + self.norm)
        row, at = np.nonzero(np.sqrt(np.maximum(0, near - slack)) - self.error <= (np.sqrt(bound) * np.float32(1 + 1e-5))[:, None])
        d = self.exact(q, row, at)
        order = np.lexsort((self.ids[at], d, row))
        row, at, d = row[order], at[order], d[order]
        turn = np.arange(len(row)) - np.searchsorted(row, row)
        top = turn < k
        found[row[top], turn[top]], far[row[top], turn[top]] = self.ids[at[top]], d[top]
        return found, far


def search_cell(index: Index, lists: dict[int, Listed], q: np.ndarray, asked: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the k best for each query among the lists that it asks for."""
    found, far = np.full((len(q), k), -1, np.int64), np.full((len(q), k), np.inf, np.float32)
    row, wanted = np.repeat(np.arange(len(q)), [len(a) for a in asked]), np.concatenate(asked)
    for at in np.unique(wanted).tolist():
        if at in lists:
            for who in np.array_split(row[wanted == at], -(-int((wanted == at).sum()) // _BLOCK)):
                f, e = lists[at].search(index, q[who], k, far[who, -1])
                f, e = np.concatenate([found[who], f], axis=1), np.concatenate([far[who], e], axis=1)
                order = np.lexsort((f, e), axis=1)[:, :k]
                found[who], far[who] = np.take_along_axis(f, order, axis=1), np.take_along_axis(e, order, axis=1)
    return found, far


def _probes(rows: DataFrame, index: Index, queries: np.ndarray, own: np.ndarray, k: int) -> int:
    """How many lists hold the share TARGET of the k nearest others of the sample, searched exhaustively."""
    width = queries.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast((index.coarse, queries, own))

    def exhaust(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, q, mine = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                y = b.slice(lo, 4096)
                x, ids = K.from_binary_rows(y.column("vec"), np.float32, width), y.column("id").to_numpy()
                d = (x**2).sum(axis=1) - 2 * (q @ x.T)
                d[mine[:, None] == ids] = np.inf
                best = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
                at = nearest(x, c)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), best.shape[1])), pa.array(np.take_along_axis(d, best, axis=1).ravel()), pa.array(at[best].ravel())], ["q", "d", "list"])

    rank = F.row_number().over(Window.partitionBy("q").orderBy("d"))
    true = mapped(rows, exhaust, "q long, d float, list long").filter("d < float('inf')").withColumn("r", rank).filter(F.col("r") <= k).select("q", "list").collect()
    order = np.argsort(np.argsort((index.coarse**2).sum(axis=1) - 2 * (queries @ index.coarse.T), axis=1), axis=1)
    places = np.sort([order[r["q"], r["list"]] for r in true])
    return int(places[min(len(places) - 1, math.ceil(TARGET * len(places)))]) + 1 if len(places) else len(index.coarse)


_ROW = "cell long, kind int, id long, list int, codes binary, vec binary, asked binary"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _members(coded: DataFrame, layout: Layout) -> DataFrame:
    """The vectors as rows of _ROW, kind 0."""
    shared = coded.sparkSession.sparkContext.broadcast(layout)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            at, ids = shared.value.group[x.column("list").to_numpy()], x.column("id").to_numpy()
            part = (K.mix64(ids.view(np.uint64)) % shared.value.parts[at].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.first[at] + part), pa.array(np.zeros(len(at), np.int32)), x.column("id"), x.column("list"), x.column("codes"), x.column("vec"), pa.nulls(len(at), pa.binary())], _NAMES)

    return mapped(coded.select("id", "list", "codes", "vec"), place, _ROW)


def _asked(queries: DataFrame, index: Index, layout: Layout, probes: int) -> DataFrame:
    """The queries (id, vec) as rows of _ROW, kind 1, one for each cell that has lists they probe."""
    shared = queries.sparkSession.sparkContext.broadcast((index.coarse, layout))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, lay = shared.value
        for x in batches:
            for lo in range(0, x.num_rows, 256):
                y = x.slice(lo, 256)
                v = K.from_binary_rows(y.column("vec"), np.float32, c.shape[1])
                d = (c**2).sum(axis=1) - 2 * (v @ c.T)
                at = np.argpartition(d, probes - 1, axis=1)[:, :probes] if probes < len(c) else np.broadcast_to(np.arange(len(c)), d.shape)
                row, at = np.repeat(np.arange(len(v)), at.shape[1]), at.ravel()
                order = np.lexsort((at, lay.group[at], row))
                row, at = row[order], at[order]
                starts, key = K.segments(row * len(lay.parts) + lay.group[at])
                lists = np.array([s.astype(np.int32).tobytes() for s in np.split(at, starts[1:])], object)
                row, group = key // len(lay.parts), key % len(lay.parts)
                n = lay.parts[group]
                part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                who = pa.array(np.repeat(row, n))
                many = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(lay.first[group], n) + part), pa.array(np.ones(many, np.int32)), y.column("id").take(who), pa.nulls(many, pa.int32()), pa.nulls(many, pa.binary()), y.column("vec").take(who), pa.array(np.repeat(lists, n), pa.binary())], _NAMES)

    return mapped(queries, probe, _ROW)


def _searched(rows: DataFrame, index: Index, k: int) -> DataFrame:
    """query, ids, far of each query and cell: the k best there. rows: of _ROW, sorted by cell and kind within partitions."""
    shared = rows.sparkSession.sparkContext.broadcast(index)
    width = index.coarse.shape[1]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        lists: dict[int, Listed] = {}
        for x in batches:
            cells, kinds = x.column("cell").to_numpy(), x.column("kind").to_numpy()
            starts, _ = K.segments(cells * 2 + kinds)
            for s, e in zip(starts, [*starts[1:], x.num_rows]):
                if cells[s] != cell:
                    cell, held, lists = cells[s], [], {}
                y = x.slice(s, e - s)
                if kinds[s] == 0:
                    held.append(y)
                    continue
                if held:
                    table = pa.Table.from_batches(held).combine_chunks()
                    at, ids = table.column("list").to_numpy(), table.column("id").to_numpy()
                    codes, vectors = K.from_binary_rows(table.column("codes"), np.uint8, len(shared.value.books)), K.from_binary_rows(table.column("vec"), np.float32, width)
                    lists = {int(n): Listed(shared.value, int(n), ids[at == n], codes[at == n], vectors[at == n]) for n in np.unique(at)}
                    held = []
                if lists:
                    q = K.from_binary_rows(y.column("vec"), np.float32, width)
                    found, far = search_cell(shared.value, lists, q, [np.frombuffer(b.as_buffer(), np.int32) for b in y.column("asked")], k)
                    some = found >= 0
                    counts = some.sum(axis=1)
                    yield pa.RecordBatch.from_arrays([y.column("id"), K.list_array(found[some], counts, pa.int64()), K.list_array(far[some], counts, pa.float32())], ["query", "ids", "far"])

    return mapped(rows, search, "query long, ids array<long>, far array<float>")


def neighbours(vectors: DataFrame, k: int = NEIGHBOURS, every: int = EVERY) -> DataFrame:
    """vec_id, neighbor_id, rank, distance: the k nearest others, among all vectors, of each whose vec_id ``every`` divides.

    Distances are Euclidean and exact; neighbours are the true ones nearly always (TARGET). Equal distances are ranked
    by neighbor_id. Fewer than k others give fewer rows; an empty table or a single vector gives none. Rows that repeat
    a vec_id are one vector (the least of theirs); null ids and vectors, values that are null or not finite and lengths
    other than the most frequent are left out. Other columns, whatever their names, aren't read.
    """
    spark = vectors.sparkSession
    rows = stored(_usable(vectors), "vectors")
    n = rows.count()
    schema = "vec_id long, neighbor_id long, rank int, distance double"
    if n < 2:
        return spark.createDataFrame([], schema)
    width = len(rows.first()["vec"]) // 4
    grain = 1 << 40
    share = min(1.0, min(FIT, FIT_BYTES // (4 * width)) / n)
    order = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(grain))
    sample = rows.filter(order < max(int(share * grain), 1)).toArrow()
    if sample.num_rows < min(n, CODES):
        sample = rows.orderBy(order, "id").limit(CODES).toArrow()
    own, x = sample.column("id").to_numpy(), K.from_binary_rows(sample.column("vec"), np.float32, width)
    mix = np.argsort(K.mix64(own.astype(np.int64).view(np.uint64)), kind="stable")
    own, x = own[mix], x[mix]
    index = fitted(x, min(MOST_LISTS, max(1, math.isqrt(n))))
    probes = min(len(index.coarse), _probes(rows, index, x[:SAMPLE], own[:SAMPLE], k))
    shared = spark.sparkContext.broadcast(index)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                y = b.slice(lo, 4096)
                v = K.from_binary_rows(y.column("vec"), np.float32, width)
                at = nearest(v, shared.value.coarse)
                rest = shared.value.split(v - shared.value.coarse[at])
                codes = np.stack([nearest(np.ascontiguousarray(rest[:, m]), book) for m, book in enumerate(shared.value.books)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([y.column("id"), pa.array(at.astype(np.int32)), K.binary_rows(codes), y.column("vec")], ["id", "list", "codes", "vec"])

    # Of equal vectors only the k + 1 smallest ids can be anybody's neighbours; the limit applies before the shuffle, too.
    same = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    coded = stored(mapped(rows.withColumn("turn", same).filter(F.col("turn") <= k + 1).select("id", "vec"), code, "id long, list int, codes binary, vec binary"), "coded")
    sizes = np.zeros(len(index.coarse), np.int64)
    for at, many in coded.groupBy("list").count().collect():
        sizes[at] = many
    layout = laid_out(index.coarse, sizes)
    mine = rows.filter(F.pmod("id", F.lit(every)) == 0)
    alike = stored(mine.groupBy("vec").agg(F.min("id").alias("query")), "queries")
    together = _members(coded, layout).unionByName(_asked(alike.select(F.col("query").alias("id"), "vec"), index, layout, probes))
    # Searched for one more than k, as a vector finds itself.
    found = _searched(together.repartition("cell").sortWithinPartitions("cell", "kind"), index, k + 1)
    flat = found.select("query", F.explode(F.arrays_zip("ids", "far")).alias("x")).select("query", F.col("x.ids").alias("neighbor_id"), F.col("x.far").alias("far"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("far", "neighbor_id"))
    best = flat.withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    named = mine.join(alike, "vec").select(F.col("id").alias("vec_id"), "query").join(best, "query").filter("vec_id <> neighbor_id")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("rank"))
    return named.withColumn("rank", rank).filter(F.col("rank") <= k).select("vec_id", "neighbor_id", F.col("rank").cast("int").alias("rank"), F.round(F.sqrt(F.col("far").cast("double")), 5).alias("distance"))
