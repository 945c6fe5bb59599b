"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed runs of N bytes (lower-cased, everything but word bytes as one space), scaled to
length 1. Each language of the labelled sample is clustered into CENTROIDS centroids by spherical k-means; a text gets
the language of the centroid with the largest cosine, or REJECTED where the distance to it is larger than that of
nearly all training texts of that language and of about that length.

Document frequencies are counted over all documents. Centroids are means over all labelled rows, and what is rejected is
measured on all of them; where clustering starts is chosen among MOST_SAMPLES ids a language (those with the smallest
hashes). Every row is classified, over its whole text. Texts are read once, into a stored table of counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymap.llm import kernels as K
from quarrymap.llm.storage import mapped, release, stored, summed

N = 3
BUCKETS = 4096
CENTROIDS, ROUNDS, SEED = 4, 8, 3
MOST_SAMPLES = 1500
REJECTED = "und"
#: Rows whose vectors are dense at the same time.
SLAB = 256
#: A cosine below this share of the least that all but REJECT_SHARE of the training texts of its length have is rejected.
SLACK, REJECT_SHARE = 0.4, 0.005
#: Upper ends of the length classes, in runs of N bytes.
LENGTHS = np.array([32, 64, 128, 256, 512, 1024, 1 << 62])

_FIND = np.uint64(64 - 12)


class Model(NamedTuple):
    names: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each, length 1
    language: np.ndarray  # of each centroid
    least: np.ndarray  # language x length class


def hashed(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the runs of N bytes of the words of each row, each word with a space before and after it."""
    w = K.words(buf, offsets)
    size = w.end - w.start
    at = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.full(at[-1] + 1, 0x20, np.uint8)
    text[np.arange(size.sum()) + np.repeat(np.arange(1, len(size) + 1), size)] = buf[np.arange(size.sum()) + np.repeat(w.start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)] if len(size) else 0
    row = np.repeat(w.row, size + 1)
    m = max(0, len(row) - N + 2)
    if not m or not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.append(row, row[-1])[:m]
    last = np.append(np.repeat(w.row, size + 1), w.row[-1])[N - 2 : N - 2 + m]
    code = np.zeros(m, np.uint64)
    for k in range(N):
        code = code * np.uint64(257) + text[k : k + m]
    same = row == last
    return row[same], (K.mix64(code[same]) >> _FIND).astype(np.int64)


def counted(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Dense counts, rows x BUCKETS."""
    row, bucket = hashed(buf, offsets)
    rows = len(offsets) - 1
    return np.bincount(row * BUCKETS + bucket, minlength=rows * BUCKETS).reshape(rows, BUCKETS)


class Bag(NamedTuple):
    """Counts of some rows: a row, a bucket and a count for each that isn't 0, in order."""

    rows: int
    row: np.ndarray
    bucket: np.ndarray
    count: np.ndarray

    def lengths(self) -> np.ndarray:
        return np.bincount(self.row, weights=self.count, minlength=self.rows)


def vectors(bag: Bag, idf: np.ndarray) -> np.ndarray:
    """Dense, rows x BUCKETS."""
    x = np.log1p(bag.count).astype(np.float32) * idf[bag.bucket]
    norm = np.sqrt(np.bincount(bag.row, weights=x * x, minlength=bag.rows))
    out = np.zeros((bag.rows, BUCKETS), np.float32)
    out[bag.row, bag.bucket] = x / np.maximum(1e-12, norm)[bag.row]
    return out


def _slabs(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Counts of at most SLAB rows at a time."""
    for a, b, buf, offsets in K.text_blocks(texts):
        for lo in range(0, b - a, SLAB):
            hi = min(b - a, lo + SLAB)
            yield a + lo, a + hi, counted(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def bag_table(docs: DataFrame) -> DataFrame:
    """(doc_id, key, lang, at, n) of every row: its buckets as bytes (null of a null text) and their counts; key stands for a null doc_id, too.

    A count above 255 is shared out to several entries of the same bucket.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for a, b, counts in _slabs(x.column("text")):
                found = np.flatnonzero(counts)
                n = counts.ravel()[found]
                entries = -(-n // 255)
                part = np.full(entries.sum(), 255, np.uint8)
                part[np.cumsum(entries) - 1] = n - 255 * (entries - 1)
                found = np.repeat(found, entries)
                ends = np.searchsorted(found, np.arange(b - a + 1) * BUCKETS)
                at, many = (pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((ends * v.itemsize).astype(np.int32).tobytes()), pa.py_buffer(v.tobytes())]) for v in ((found % BUCKETS).astype(np.uint16), part))
                at = pc.if_else(x.column("text").slice(a, b - a).is_valid(), at, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([*(x.column(c).slice(a, b - a) for c in ("doc_id", "key", "lang")), at, many], ["doc_id", "key", "lang", "at", "n"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"), F.col("lang").cast("string").alias("lang"), "text")
    return mapped(slim, take, "doc_id long, key long, lang string, at binary, n binary")


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and where each row's begin and end (a null has none)."""
    column = pc.fill_null(column, b"")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(kind), (ends - ends[0]) // np.dtype(kind).itemsize


def _bags(x: pa.RecordBatch) -> Iterator[tuple[int, int, Bag]]:
    """Those of ``bag_table``, at most SLAB rows at a time."""
    (at, ends), (n, _) = _flat(x.column("at"), np.uint16), _flat(x.column("n"), np.uint8)
    for lo in range(0, x.num_rows, SLAB):
        hi = min(x.num_rows, lo + SLAB)
        part = slice(ends[lo], ends[hi])
        starts, code = K.segments(np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1])) * BUCKETS + at[part])
        yield lo, hi, Bag(hi - lo, code // BUCKETS, code % BUCKETS, np.add.reduceat(n[part].astype(np.int64), starts) if len(starts) else starts)


def document_frequencies(docs: DataFrame, bags: DataFrame | None = None) -> tuple[np.ndarray, int]:
    """In how many rows each bucket occurs, and how many rows there are, over all rows with a text; bags: their table, if it is there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BUCKETS, np.int64), 0
        for x in batches:
            rows += x.num_rows
            for _, _, bag in _bags(x):
                total += np.bincount(bag.bucket, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 64]), pa.array([rows]), pa.array([total.tobytes()], pa.binary())], ["part", "rows", "seen"])

    def add(table: pa.Table) -> pa.Table:
        seen = sum((np.frombuffer(b.as_buffer(), np.int64) for b in table.column("seen")), np.zeros(BUCKETS, np.int64))
        return pa.table({"rows": pa.array([sum(table.column("rows").to_pylist())]), "seen": pa.array([seen.tobytes()], pa.binary())})

    # 64 partial sums come to the driver, however many partitions there are.
    bags = bag_table(docs) if bags is None else bags
    parts = mapped(bags.filter("at IS NOT NULL").select("at", "n"), count, "part long, rows long, seen binary").groupBy("part").applyInArrow(add, "rows long, seen binary").collect()
    return sum((np.frombuffer(p["seen"], np.int64) for p in parts), np.zeros(BUCKETS, np.int64)), sum(p["rows"] for p in parts)


def _starts(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Up to CENTROIDS rows far from one another."""
    centres = x[[int(rng.integers(len(x)))]]
    while len(centres) < min(CENTROIDS, len(x)):
        centres = np.vstack([centres, x[[int(np.argmin((x @ centres.T).max(axis=1)))]]])
    return centres


def sampled_ids(labelled: DataFrame) -> DataFrame | None:
    """(doc_id, lang) of the MOST_SAMPLES ids of each language with the smallest hashes; None where there are no rows.

    A bound on the hash, from a language's number of rows, leaves little more than the sample before anything is
    shuffled. Where fewer ids pass than are wanted (as some have many rows) it is raised and the rows are read again.
    """
    code = F.xxhash64("doc_id", F.lit(SEED))
    rows = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    wanted = {lang: MOST_SAMPLES + 10 * math.isqrt(MOST_SAMPLES) for lang in rows}
    while rows:
        bounds = {lang: (1 << 63) - 1 if wanted[lang] >= n else -(1 << 63) + (wanted[lang] << 64) // n for lang, n in rows.items()}
        bound = F.create_map(*[x for lang, v in bounds.items() for x in (F.lit(lang), F.lit(v).cast("long"))])
        passed = stored(labelled.filter(code <= F.element_at(bound, F.col("lang"))).select("lang", "doc_id").distinct(), "passed")
        found = {r["lang"]: r["count"] for r in passed.groupBy("lang").count().collect()}
        short = [lang for lang, n in rows.items() if wanted[lang] < n and found.get(lang, 0) < MOST_SAMPLES]
        if not short:
            turn = F.row_number().over(Window.partitionBy("lang").orderBy(code, "doc_id"))
            return passed.withColumn("k", turn).filter(F.col("k") <= MOST_SAMPLES).select("doc_id", "lang")
        release(passed)
        for lang in short:
            wanted[lang] *= 8
    return None


def _of_own(m: Model, x: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid of its own language, cosine) of each row; lang: its place in the names."""
    cosines = np.where(m.language == lang[:, None], x @ m.centroids.T, -np.inf)
    near = cosines.argmax(axis=1)
    return near, cosines[np.arange(len(near)), near]


def _places(m: Model, lang: pa.Array) -> np.ndarray:
    return pc.index_in(lang, pa.array(m.names, pa.string())).to_numpy()


def _moved(labelled: DataFrame, m: Model) -> Model:
    """One round of spherical k-means over all labelled rows; a centroid that is the nearest of none stays."""
    shared = labelled.sparkSession.sparkContext.broadcast(m)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sums = np.zeros(m.centroids.shape)
        for x in batches:
            lang = _places(m, x.column("lang"))
            for lo, hi, bag in _bags(x):
                v = vectors(bag, m.idf)
                near, _ = _of_own(m, v, lang[lo:hi])
                sums += (np.arange(len(sums))[:, None] == near).astype(np.float32) @ v
        some = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), TaskContext.get().partitionId() % 64)), K.binary_rows(sums[some].astype(np.float32))], ["k", "part", "w"])

    centroids = m.centroids.copy()
    for k, total in summed(mapped(labelled.select("lang", "at", "n"), add, "k long, part long, w binary"), np.float32, np.float64).items():
        centroids[k] = total / np.linalg.norm(total)
    shared.unpersist()
    return m._replace(centroids=centroids)


def _least(labelled: DataFrame, m: Model) -> np.ndarray:
    """SLACK times the REJECT_SHARE quantile of the cosines of all labelled rows of each language and length class.

    Cosines have six digits, so there are at most about a million different ones of each, which are counted.
    """
    shared = labelled.sparkSession.sparkContext.broadcast(m)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            lang = _places(shared.value, x.column("lang"))
            for lo, hi, bag in _bags(x):
                top = _of_own(shared.value, vectors(bag, shared.value.idf), lang[lo:hi])[1]
                yield pa.RecordBatch.from_arrays([pa.array(lang[lo:hi].astype(np.int64)), pa.array(np.searchsorted(LENGTHS, bag.lengths())), pa.array(np.rint(top * 1e6).astype(np.int64))], ["k", "c", "top"])

    tallied = mapped(labelled.select("lang", "at", "n"), measure, "k long, c long, top long").groupBy("k", "c", "top").agg(F.count("*").alias("n"))
    own = Window.partitionBy("k", "c")
    place = F.lit(REJECT_SHARE) * (F.sum("n").over(own) - 1)
    ranked = tallied.select("k", "c", "top", F.sum("n").over(own.orderBy("top")).alias("upto"), place.alias("place"))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("top")))
    out = np.zeros((len(m.names), len(LENGTHS)))
    for r in ranked.groupBy("k", "c", "place").agg(at(F.floor("place")).alias("low"), at(F.ceil("place")).alias("high")).collect():
        out[r["k"], r["c"]] = SLACK * (r["low"] + (r["high"] - r["low"]) * (r["place"] % 1)) / 1e6
    # A short text is never asked for more than a longer one.
    return np.minimum.accumulate(out[:, ::-1], axis=1)[:, ::-1]


def train(docs: DataFrame, bags: DataFrame) -> Model | None:
    """The model of all rows of a stored ``bag_table``; None where no row has a language and a word."""
    labelled = bags.filter("lang IS NOT NULL AND length(at) > 0")
    ids = sampled_ids(labelled.select(F.col("key").alias("doc_id"), "lang"))
    if ids is None:
        return None
    seen, rows = document_frequencies(docs, bags)
    idf = (np.log((1 + rows) / (1 + seen)) + 0.1).astype(np.float32)
    # Of rows that repeat an id the least counts as a start.
    some = labelled.join(F.broadcast(ids.withColumnRenamed("doc_id", "key")), ["key", "lang"]).groupBy("key", "lang").agg(F.min(F.struct("at", "n")).alias("bag")).select("lang", "bag.*")
    got = some.toArrow().combine_chunks().sort_by([("lang", "ascending"), ("at", "ascending"), ("n", "ascending")])
    names = sorted(set(got.column("lang").to_pylist()))
    starts = []
    for name in names:
        own = got.filter(pc.equal(got.column("lang"), name)).combine_chunks().to_batches()
        starts.append(_starts(np.vstack([vectors(bag, idf) for x in own for _, _, bag in _bags(x)]), np.random.default_rng(SEED)))
    m = Model(names, idf, np.vstack(starts), np.repeat(np.arange(len(names)), [len(x) for x in starts]), np.zeros((len(names), len(LENGTHS))))
    for _ in range(ROUNDS):
        before, m = m, _moved(labelled, m)
        if np.allclose(before.centroids, m.centroids, atol=1e-7):
            break
    return m._replace(least=_least(labelled, m))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, predicted, cosine for every row of ``docs``; languages are learned from its own lang column.

    REJECTED stands for texts unlike any language, and for null and empty texts and those without a word (cosine 0);
    where no row has a language every row gets it. Rows that repeat a doc_id are classified each by its text, rows
    without one as well; equal cosines give the language that comes first by name. An empty table gives an empty one.
    Other columns, whatever their names, aren't read.
    """
    bags = stored(bag_table(docs), "bags")
    model = train(docs, bags)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for x in batches:
            if m is None:
                yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array([REJECTED] * x.num_rows, pa.string()), pa.array(np.zeros(x.num_rows))], ["doc_id", "predicted", "cosine"])
                continue
            names = pa.array([*m.names, REJECTED])
            for a, b, bag in _bags(x):
                cosines = vectors(bag, m.idf) @ m.centroids.T
                best = cosines.argmax(axis=1)
                top = np.round(cosines[np.arange(len(best)), best].astype(np.float64), 6)
                lang = m.language[best]
                length = bag.lengths()
                poor = (length == 0) | (top < m.least[lang, np.searchsorted(LENGTHS, length)])
                yield pa.RecordBatch.from_arrays([x.column("doc_id").slice(a, b - a), names.take(pa.array(np.where(poor, len(m.names), lang))), pa.array(top)], ["doc_id", "predicted", "cosine"])

    return mapped(bags.select("doc_id", "at", "n"), classify, "doc_id long, predicted string, cosine double")
