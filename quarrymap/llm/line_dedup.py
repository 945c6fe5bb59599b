"""Removal of lines that occur before, anywhere in the corpus.

Two Bloom filters over the same positions screen the lines: ``once`` has the bits of every line's hash, ``twice`` the
bits that were hit again. Each partition sends its bits as sparse positions, and merging two partitions sets in
``twice`` what both have in ``once``; so a line that occurs twice always has all its bits in ``twice``. Only lines
that do (the suspects) shuffle, with their whole text: grouping by that text confirms repeats exactly, and partial
aggregation keeps a hot line to one row a partition. What comes back to a document is the numbers of its suspect lines
that are first occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymap.llm import kernels as K
from quarrymap.llm.storage import mapped

PROBES = 3
BITS_PER_LINE = 16
#: The filter that is broadcast has at most so many bits (256 MB); beyond that more lines are suspects, and results stay exact.
MOST_BITS = 1 << 31
_CHUNK_BITS = 19

_NEWLINE = 0x0A
_SPACE = np.zeros(256, bool)
_SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True


def split_lines(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the lines of each row; a row of n newlines has n + 1 lines."""
    breaks = np.flatnonzero(buf == _NEWLINE)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    # A line that starts where an empty row does belongs to the row by order, so rows follow from counts.
    counts = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    return start, end, np.repeat(np.arange(len(offsets) - 1), counts)


def line_table(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, hash, blank) of all lines of a block."""
    start, end, row = split_lines(buf, offsets)
    solid = np.concatenate([[0], np.cumsum(~_SPACE[buf])])
    return start, end, row, K.range_hashes(buf, start, end), solid[start] == solid[end]


def probes(code: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = K.mix64(code + np.uint64(0x632BE5AB)) | np.uint64(1)
    for k in range(PROBES):
        yield (code + np.uint64(k) * step) & np.uint64(bits - 1)


def suspects(code: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Which hashes have all their bits in the packed filter."""
    out = np.ones(len(code), bool)
    for at in probes(code, len(twice) * 8):
        out &= (twice[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def twice_filter(docs: DataFrame) -> np.ndarray:
    """Packed bits that more than one line hit."""
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    bits = min(MOST_BITS, 1 << max(_CHUNK_BITS, (lines * BITS_PER_LINE).bit_length()))
    mask = np.uint64((1 << _CHUNK_BITS) - 1)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        for x in batches:
            for _, _, buf, offsets in K.text_blocks(x.column("text"), lower=False):
                _, _, _, code, blank = line_table(buf, offsets)
                seen += probes(code[~blank], bits)
        if not seen:
            return
        at, count = np.unique(np.concatenate(seen), return_counts=True)
        cuts, chunks = K.segments(at >> np.uint64(_CHUNK_BITS))
        for s, e, chunk in zip(cuts, [*cuts[1:], len(at)], chunks):
            local = (at[s:e] & mask).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([int(chunk)]), pa.array([local.tobytes()], pa.binary()), pa.array([local[count[s:e] > 1].tobytes()], pa.binary())], ["chunk", "once", "twice"])

    def merge(table: pa.Table) -> pa.Table:
        once, twice = np.zeros(1 << _CHUNK_BITS, bool), np.zeros(1 << _CHUNK_BITS, bool)
        for a, b in zip(table.column("once"), table.column("twice")):
            new = np.frombuffer(a.as_buffer(), np.uint32)
            twice[new[once[new]]] = True
            once[new] = True
            twice[np.frombuffer(b.as_buffer(), np.uint32)] = True
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "twice": pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())})

    merged = mapped(docs.select("text"), partial, "chunk long, once binary, twice binary").groupBy("chunk").applyInArrow(merge, "chunk long, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    each = 1 << (_CHUNK_BITS - 3)
    for chunk, part in merged.toLocalIterator():
        out[chunk * each : (chunk + 1) * each] = np.frombuffer(part, np.uint8)
    return out


def _gather(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as strings."""
    size = end - start
    ends = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(buf[take].tobytes())]).cast(pa.string())


def without(buf: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Each row's kept lines, joined by newlines."""
    after = np.zeros(len(row), bool)  # whether a kept line of the same row follows
    kept = np.flatnonzero(keep)
    after[kept[:-1]] = row[kept[:-1]] == row[kept[1:]]
    delta = np.zeros(len(buf) + 2, np.int8)
    np.add.at(delta, start[kept], 1)
    np.add.at(delta, end[kept] + after[kept], -1)
    inside = np.cumsum(delta[: len(buf)], dtype=np.int8) > 0
    sizes = np.concatenate([[0], np.cumsum(inside)])[offsets].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(sizes.tobytes()), pa.py_buffer(buf[inside].tobytes())]).cast(pa.string())


def deduplicated(docs: DataFrame, twice: np.ndarray | None = None) -> DataFrame:
    """row, clean, n_removed for every row of ``docs``, whose columns are packed in row; each text moves once."""
    shared = docs.sparkSession.sparkContext.broadcast(twice_filter(docs) if twice is None else twice)
    packed = docs.select(F.col("doc_id").cast("long").alias("key"), F.xxhash64("text").alias("h"), F.struct("*").alias("row"))

    def suspect_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for a, b, buf, offsets in K.text_blocks(x.column("body"), lower=False):
                start, end, row, code, blank = line_table(buf, offsets)
                hit = suspects(code, shared.value) & ~blank
                number = np.arange(len(row)) - np.searchsorted(row, row)
                row = pa.array(row[hit])
                yield pa.RecordBatch.from_arrays([x.column("key").slice(a, b - a).take(row), x.column("h").slice(a, b - a).take(row), pa.array(number[hit].astype(np.int32)), _gather(buf, start[hit], end[hit])], ["key", "h", "number", "line"])

    order = F.struct(F.col("key").isNull().alias("z"), "key", "h", "number")
    lines = mapped(packed.select("key", "h", F.col("row.text").alias("body")), suspect_lines, "key long, h long, number int, line string")
    first = lines.groupBy("line").agg(F.min(order).alias("f")).select("f.*")
    first = first.groupBy(F.col("key").alias("fk"), F.col("h").alias("fh")).agg(F.collect_list("number").alias("firsts"))
    joined = packed.join(first, packed.key.eqNullSafe(first.fk) & (packed.h == first.fh), "left").drop("fk", "fh")
    joined = joined.withColumn("turn", F.row_number().over(Window.partitionBy("key", "h").orderBy("h")))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            body, firsts, turn = x.column("row").field("text"), x.column("firsts"), x.column("turn").to_numpy()
            texts, removed = [], []
            for a, b, buf, offsets in K.text_blocks(body, lower=False):
                start, end, row, code, blank = line_table(buf, offsets)
                keep = ~suspects(code, shared.value) | blank
                begin = np.searchsorted(row, np.arange(b - a))
                mine = firsts.slice(a, b - a)
                numbers = mine.flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(b - a), pa.compute.fill_null(pa.compute.list_value_length(mine), 0).to_numpy(zero_copy_only=False))
                keep[begin[owner] + numbers] = True
                keep &= blank | (turn[a:b] == 1)[row]
                texts.append(without(buf, offsets, start, end, row, keep))
                removed.append(np.bincount(row[~keep], minlength=b - a))
            if texts:
                text = pa.concat_arrays(texts)
                text = pa.compute.if_else(body.is_null(), pa.scalar(None, pa.string()), text)
                yield pa.RecordBatch.from_arrays([x.column("row"), text, pa.array(np.concatenate(removed).astype(np.int64))], ["row", "clean", "n_removed"])

    schema = joined.select("row").schema.add("clean", "string").add("n_removed", "long")
    return mapped(joined.select("row", "firsts", "turn"), clean, schema)


def deduplicate_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_removed for every row of ``docs``: its text without the lines that occur before.

    Lines end at newlines and are compared byte by byte. Before means in order of doc_id (null last), then of the
    text's hash, then of the line's number. A line of white space only is never removed. Of rows that are wholly the
    same all but one lose all their lines. A null text stays null; an empty text stays empty; an empty table gives an
    empty one. Other columns, whatever their names, aren't read.
    """
    return deduplicated(docs.select("doc_id", "text")).select(F.col("row.doc_id").alias("doc_id"), F.col("clean").alias("text"), "n_removed")


def keep_first_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with text (and n_chars, where there is one) after deduplicate_lines; the rest as it is.

    A row of which no solid line is left is dropped, as all it had is elsewhere; one that had none to begin with stays.
    """
    done = deduplicated(docs).filter("n_removed = 0 OR clean RLIKE '\\\\S'")
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return done.select(*[F.when(F.col("n_removed") == 0, F.col("row")[c]).otherwise(new[c].cast(t)).alias(c) if c in new else F.col("row")[c].alias(c) for c, t in docs.dtypes])


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, i, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
), marked AS (
  SELECT doc_id, i, line, NOT regexp_matches(line, '[^ \\t\\r\\v\\f]') OR row_number() OVER (PARTITION BY line ORDER BY doc_id, i) = 1 AS keep FROM lines
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keep), '') AS text, count(*) FILTER (NOT keep) AS n_removed FROM marked GROUP BY doc_id
"""
