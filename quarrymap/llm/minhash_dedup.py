"""Near-duplicate removal by one-permutation MinHash.

Shingles are runs of SHINGLE words (``kernels``). One hash of each shingle picks a bin by its top bits and competes
in it by the rest; empty bins are filled by optimal densification (Shrivastava, 2017): bin i copies the first
non-empty bin of a random sequence that is the same for all documents. BANDS keys of ROWS bins each find candidates,
``lsh`` links each to its bucket's smallest id, and a link holds if the BINS signatures agree to THRESHOLD. Of rows that
repeat a doc_id the text with the least signature hash counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymap.llm import kernels as K
from quarrymap.llm.lsh import components, similar_edges
from quarrymap.llm.storage import mapped, stored

SHINGLE = 3
BINS = 256
BANDS = 64
ROWS = BINS // BANDS
THRESHOLD = 0.45

#: Rows of a pass: BINS values of 8 bytes each.
_ROWS = 1024
_EMPTY = np.uint64(2**64 - 1)
_BIN_BITS = BINS.bit_length() - 1


def signatures(row: np.ndarray, code: np.ndarray, rows: int) -> np.ndarray:
    """rows x BINS bin minima, densified; a row without shingles stays empty."""
    sig = np.full(rows * BINS, _EMPTY, dtype=np.uint64)
    np.minimum.at(sig, row * BINS + (code >> np.uint64(64 - _BIN_BITS)).astype(np.int64), code & np.uint64((1 << (64 - _BIN_BITS)) - 1))
    sig = sig.reshape(rows, BINS)
    bare = sig == _EMPTY
    at, slot = np.nonzero(bare & ~bare.all(axis=1)[:, None])
    source, turn = sig.copy(), 0
    while len(at):
        turn += 1
        pick = (K.mix64(slot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn)) >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
        value = source[at, pick]
        hit = value != _EMPTY
        sig[at[hit], slot[hit]] = value[hit]
        at, slot = at[~hit], slot[~hit]
    return sig


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key a band of each row."""
    parts = sig.reshape(len(sig), bands, sig.shape[1] // bands)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        key = K.mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key


def signature_table(docs: DataFrame) -> DataFrame:
    """(id, bands, sig, same) of the rows with an id and at least one word; same: a hash of the whole signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids = x.column("id")
            for a, b, buf, offsets in K.text_blocks(x.column("text"), rows=_ROWS):
                row, code = K.shingles(K.words(buf, offsets), b - a, SHINGLE)
                some = np.unique(row)
                sig = signatures(np.searchsorted(some, row), code, len(some))
                keys = band_keys(sig, BANDS)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).take(pa.array(some)), K.list_array(keys.view(np.int64).ravel(), np.full(len(some), BANDS), pa.int64()), K.binary_rows(K.mix64(sig).astype(np.uint8)), pa.array(band_keys(keys, 1).view(np.int64)[:, 0])], ["id", "bands", "sig", "same"])

    slim = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text")
    return mapped(slim, sign, "id long, bands array<long>, sig binary, same long")


def links(docs: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all near copies: stars around the smallest id of equal signatures and of each bucket."""
    signed = stored(signature_table(docs), "signatures")
    again = signed.groupBy("id").agg(F.min("same").alias("same"), F.count("*").alias("n")).filter("n > 1")
    if not again.isEmpty():
        one = signed.join(again.select("id", F.col("same").alias("kept")), "id", "left").filter("kept IS NULL OR kept = same")
        signed = stored(one.select(signed.columns).dropDuplicates(["id"]), "signatures")
    return similar_edges(signed, BINS, THRESHOLD)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, group_id, n_links, is_duplicate for every row of ``docs``.

    group_id is the smallest doc_id of the group (its own for a document without a copy); exactly one row of a group
    has is_duplicate false. n_links counts the documents that it is linked with directly (``links``). Rows that repeat a
    doc_id are one document: all but one are duplicates. A null or empty text (or one without words) is like no other
    document. A row without doc_id can't be named, so it is never a duplicate and its group_id is null. Other columns,
    whatever their names, aren't read.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    edges = stored(links(docs), "links")
    degree = edges.select(F.col("a").alias("id")).union(edges.select("b")).groupBy("id").agg(F.count("*").alias("n_links"))
    root = components(edges).join(degree, "id")
    named = ids.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    named = named.join(root, named.doc_id == root.id, "left").select("doc_id", F.coalesce("root", "doc_id").alias("group_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n")
    # A row for each of the n rows that repeat a doc_id, in two steps, as one array of n numbers may be too long.
    named = named.select("doc_id", "group_id", "n_links", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _ROWS))).alias("part"))
    named = named.select("doc_id", "group_id", "n_links", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(_ROWS - 1), F.col("n") - 1 - F.col("part") * _ROWS))).alias("turn"))
    named = named.select("doc_id", "group_id", "n_links", ((F.col("doc_id") != F.col("group_id")) | (F.col("part") + F.col("turn") > 0)).alias("is_duplicate"))
    return named.unionByName(ids.filter("doc_id IS NULL").select("doc_id", F.col("doc_id").alias("group_id"), F.lit(0).cast("long").alias("n_links"), F.lit(False).alias("is_duplicate")))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the duplicates of near_duplicates; all columns as they are.

    Of rows that repeat a doc_id the one with the smallest text hash (then the smallest hash of all columns) stays. Rows
    without doc_id stay, as do null and empty texts; an empty table gives an empty one.
    """
    gone = components(links(docs)).filter("id <> root").select(F.col("id").alias("gone"))
    packed = docs.select(F.col("doc_id").cast("long").alias("key"), F.xxhash64("text").alias("h"), F.struct("*").alias("row"))
    named = packed.filter("key IS NOT NULL").join(gone, F.col("key") == F.col("gone"), "left_anti")
    first = F.row_number().over(Window.partitionBy("key").orderBy("h", F.xxhash64("row")))
    named = named.withColumn("turn", first).filter("turn = 1").select("row.*")
    return named.unionByName(packed.filter("key IS NULL").select("row.*"))
