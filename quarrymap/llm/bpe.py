"""Byte-pair encoding and decoding with a published vocabulary (never trained here).

Texts are cut into pieces by the vocabulary's pattern. The most frequent pieces of the corpus, counted over all
documents, are compiled with their token ids into a lexicon: a minimal acyclic transducer whose states share prefixes
and suffixes and whose transitions carry numbers that add up to the piece's place in the id table. It is laid out as a
double array in one file, shipped once to every executor and memory-mapped there, and walked for all pieces of a block
at once. Pieces outside of the lexicon are merged exactly, pair by pair in order of rank, many pieces at a time.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymap.llm import kernels as K
from quarrymap.llm.storage import checkpoint_dir, stored
from quarrymap.llm.storage import mapped as in_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces in the lexicon, and the bytes of the longest. Others are merged, with the same ids.
LEXICON_SIZE, LONGEST = 1 << 16, 48
#: Longer pieces, in bytes, are merged one by one with a heap.
_MATRIX = 64
_FLUSH = 1 << 18


_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point, as the pattern sees it."""
    if not _classes:
        table = np.full(0x110000, _OTHER, np.uint8)
        points = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        for kind, name in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(name, points):
                shift = [0x800 if k >= 0xD800 else 0 for k in (m.start(), m.end() - 1)]
                table[m.start() + shift[0] : m.end() + shift[1]] = kind
        _classes.append(table)
    return _classes[0]


def cut(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each piece, number of pieces of each row): what PATTERN finds in each text of a block, in numpy passes.

    A run of letters, of digits or of other marks is a piece, with the one space (0x20) before it, if there is one. Of a
    run of white space what that leaves is a piece, but for the last character where it isn't a space and text follows,
    which is a piece itself. An apostrophe that starts a piece takes s, t, re, ve, m, ll or d with it.
    """
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    if len(points) == len(buf):
        at, row_first = None, offsets
    else:
        at = np.flatnonzero((buf & 0xC0) != 0x80)
        row_first = np.searchsorted(at, offsets)
    n = len(points)
    kind = classes()[points]
    head = np.zeros(n + 1, bool)  # first characters of rows
    head[row_first] = True
    begin = np.ones(n + 1, bool)  # first characters of runs; the end counts as one
    begin[1:n] = kind[1:] != kind[:-1]
    begin |= head
    space = kind == _SPACE
    # The last character of a white-space run that text of the same row follows.
    tail = np.zeros(n, bool)
    tail[:-1] = space[:-1] & begin[1:n] & ~head[1:n] & ~space[1:]
    joins = tail & (points == 0x20)
    begin[:n] |= tail
    begin[1:n] &= ~joins[:-1] | head[1:n]
    # Contractions: a lone apostrophe that starts a piece, with letters after it.
    mark = np.flatnonzero((points[:-1] == 0x27) & begin[: n - 1] & (kind[1:] == _LETTER) & ~head[1:n])
    if len(mark):
        one = points[mark + 1]
        two = np.where((mark + 2 < n) & ~head[np.minimum(mark + 2, n)], points[np.minimum(mark + 2, n - 1)], 0)
        long = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        short = np.isin(one, [0x73, 0x74, 0x6D, 0x64])
        begin[mark[long | short] + 1] = False
        begin[mark[short] + 2] = True
        begin[mark[long] + 3] = True
    first = np.flatnonzero(begin[:n])
    pieces = np.diff(np.searchsorted(first, row_first))
    return (first if at is None else at[first]), pieces


def read_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of a piece: of all neighbours whose union is a token, the lowest rank merges first, the leftmost on ties."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) <= 40:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]
    n = len(piece)
    part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        if part[i] is None or right[i] >= n or part[i] + part[right[i]] != both:
            continue
        gone = right[i]
        part[i], part[gone] = both, None
        right[i] = right[gone]
        if right[i] < n:
            left[right[i]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < n and (r := ranks.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (r, a, part[a] + part[b]))
    return [ranks[p] for p in part if p is not None]


class Lexicon(NamedTuple):
    """base, final: of each state; check, target, add: of each slot of the double array; ends, ids: of each piece.

    left, right, union: pairs of tokens and what they merge to, sorted by bucket; first: where each bucket begins.
    """

    base: np.ndarray
    final: np.ndarray
    check: np.ndarray
    target: np.ndarray
    add: np.ndarray
    ends: np.ndarray
    ids: np.ndarray
    left: np.ndarray
    right: np.ndarray
    union: np.ndarray
    first: np.ndarray


_PAIR_BITS = 19


def _bucket(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)


def _pairs(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of tokens that join to a token."""
    found = [(a, b, whole) for token, whole in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None]
    left, right, union = np.array(found, np.int32).reshape(-1, 3).T
    bucket = _bucket(left, right)
    order = np.argsort(bucket, kind="stable")
    first = np.searchsorted(bucket[order], np.arange((1 << _PAIR_BITS) + 1)).astype(np.int32)
    return left[order], right[order], union[order], first


_NONE = np.int32(2**31 - 1)


def _union(lexicon: Lexicon, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What each pair merges to, _NONE if to nothing."""
    out = np.full(left.shape, _NONE, np.int32)
    bucket = _bucket(np.maximum(left, 0), np.maximum(right, 0))
    at, end = lexicon.first[bucket].astype(np.int64), lexicon.first[bucket + 1]
    todo = np.nonzero((right >= 0) & (at < end))
    while len(todo[0]):
        here = at[todo]
        hit = (lexicon.left[here] == left[todo]) & (lexicon.right[here] == right[todo])
        out[tuple(t[hit] for t in todo)] = lexicon.union[here[hit]]
        at[todo] += 1
        more = ~hit & (at[todo] < end[todo])
        todo = tuple(t[more] for t in todo)
    return out


def merge_many(lexicon: Lexicon, tokens: np.ndarray) -> np.ndarray:
    """What merge does, for each row of single-byte token ids, padded with -1."""
    done = np.full(tokens.shape, -1, np.int32)
    row, now = np.arange(len(tokens)), tokens
    rank = _union(lexicon, now[:, :-1], now[:, 1:])
    while len(row):
        if rank.shape[1] == 0:
            done[row, : now.shape[1]] = now
            break
        best = rank.argmin(axis=1)
        union = rank[np.arange(len(row)), best]
        over = union == _NONE
        if over.any():
            done[row[over], : now.shape[1]] = now[over]
            row, now, rank, best, union = row[~over], now[~over], rank[~over], best[~over], union[~over]
            if not len(row):
                break
        k = np.arange(len(row))
        now[k, best] = union
        place = np.arange(now.shape[1] - 1)
        now = np.take_along_axis(now, place + (place > best[:, None]), axis=1)
        place = np.arange(rank.shape[1] - 1)
        rank = np.take_along_axis(rank, place + (place >= best[:, None]), axis=1)
        for at in (best - 1, best):
            ok = (at >= 0) & (at < rank.shape[1])
            rank[k[ok], at[ok]] = _union(lexicon, now[k[ok], at[ok]], now[k[ok], at[ok] + 1])
    return done


def compile_lexicon(pieces: list[bytes], ranks: dict[bytes, int]) -> Lexicon:
    """The minimal transducer of the distinct pieces, which get their numbers in sorted order."""
    pieces = sorted(p for p in set(pieces) if p)
    children: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path = [0]

    def settle(keep: int) -> None:
        """Replaces the states of the last piece beyond its first ``keep`` by equal ones that are there already."""
        while len(path) > keep + 1:
            state, parent = path.pop(), path[-1]
            key = (final[state], tuple(children[state].items()))
            byte = next(reversed(children[parent]))
            children[parent][byte] = register.setdefault(key, state)

    last = b""
    for piece in pieces:
        shared = 0
        while shared < min(len(last), len(piece)) and last[shared] == piece[shared]:
            shared += 1
        settle(shared)
        for byte in piece[shared:]:
            children.append({})
            final.append(False)
            children[path[-1]][byte] = len(children) - 1
            path.append(len(children) - 1)
        final[path[-1]] = True
        last = piece
    settle(0)
    number, order, stack = {0: 0}, [0], [0]
    while stack:
        for to in children[stack.pop()].values():
            if to not in number:
                number[to] = len(order)
                order.append(to)
                stack.append(to)
    words: dict[int, int] = {}
    todo = [0]
    while todo:
        state = todo[-1]
        open_ = [t for t in children[state].values() if t not in words]
        if open_:
            todo += open_
        else:
            words[state] = final[state] + sum(words[t] for t in children[state].values())
            todo.pop()
    taken = bytearray(4 * sum(len(children[s]) for s in order) + 4096)
    check, target, add = (np.full(len(taken), fill, np.int32) for fill in (-1, 0, 0))
    base = np.zeros(len(order), np.int32)
    # Where to look for room, by the number of transitions: the search never goes back, which leaves some holes.
    hint = [256] * 257
    for state in sorted(order, key=lambda s: -len(children[s])):
        out = sorted(children[state])
        if not out:
            continue
        low, at = out[0], taken.find(0, hint[len(out)])
        while any(taken[at - low + b] for b in out):
            at = taken.find(0, at + 1)
        hint[len(out)] = at + 1
        base[number[state]] = at - low
        before = int(final[state])
        for byte in out:
            slot = at - low + byte
            taken[slot] = 1
            check[slot], target[slot], add[slot] = number[state], number[children[state][byte]], before
            before += words[children[state][byte]]
    top = taken.rfind(1) + 513
    check, target, add = check[:top], target[:top], add[:top]
    merged = [merge(p, ranks) for p in pieces]
    return Lexicon(base, np.array([final[s] for s in order], np.int32), check, target, add, np.concatenate([[0], np.cumsum([len(m) for m in merged])]).astype(np.int32), np.array([i for m in merged for i in m], np.int32), *_pairs(ranks))


def packed(lexicon: Lexicon) -> bytes:
    """One file: the lengths of the arrays, then the arrays."""
    return np.array([len(x) for x in lexicon], np.int32).tobytes() + b"".join(x.tobytes() for x in lexicon)


def mapped(path: str) -> Lexicon:
    """The arrays of a file, memory-mapped."""
    data = np.memmap(path, np.int32, "r")
    n = len(Lexicon._fields)
    ends = n + np.cumsum(data[:n], dtype=np.int64)
    return Lexicon(*(data[e - s : e] for e, s in zip(ends, data[:n])))


def look_up(lexicon: Lexicon, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The number of each piece (a byte range) in the lexicon, -1 if it isn't there."""
    out = np.full(len(start), -1, np.int64)
    live = np.flatnonzero((size <= LONGEST) & (size > 0))
    state, total = np.zeros(len(live), np.int32), np.zeros(len(live), np.int64)
    first, length = start[live], size[live]
    step = 0
    while len(live):
        slot = lexicon.base[state] + buf[first + step]
        good = lexicon.check[slot] == state
        slot = slot[good]
        live, first, length = live[good], first[good], length[good]
        state, total = lexicon.target[slot], total[good] + lexicon.add[slot]
        step += 1
        over = length == step
        done = over & (lexicon.final[state] == 1)
        out[live[done]] = total[done]
        live, first, length, state, total = live[~over], first[~over], length[~over], state[~over], total[~over]
    return out


def frequent_pieces(docs: DataFrame, most: int = LEXICON_SIZE) -> list[bytes]:
    """The most frequent pieces of all documents, ties by the piece."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])
            seen.clear()
            return rows

        for x in batches:
            for _, _, buf, offsets in K.text_blocks(x.column("text"), lower=False):
                start, _ = cut(buf, offsets)
                end = np.append(start[1:], len(buf))
                keep = end - start <= LONGEST
                start, end = start[keep], end[keep]
                _, some, n = np.unique(K.range_hashes(buf, start, end), return_index=True, return_counts=True)
                data = buf.tobytes()
                for s, e, k in zip(start[some].tolist(), end[some].tolist(), n.tolist()):
                    seen[data[s:e]] += k
                if len(seen) > _FLUSH:
                    yield flush()
        if seen:
            yield flush()

    found = in_batches(docs.filter("text IS NOT NULL").select("text"), count, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    # Stored first: collecting a sorted limit would bring that many rows of every partition to the driver.
    top = stored(found.orderBy(F.desc("n"), "piece").limit(most), "pieces")
    return [bytes(row[0]) for row in top.select("piece").collect()]


class Coder:
    """Encodes and decodes blocks of texts."""

    def __init__(self, ranks: dict[bytes, int], lexicon: Lexicon):
        self.ranks, self.lexicon = ranks, lexicon
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        self.ends = np.concatenate([[0], np.cumsum([len(t) for t in table])])
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def _merged(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of pieces that aren't in the lexicon."""
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        _, some, which = np.unique(K.range_hashes(buf, start, start + size), return_index=True, return_inverse=True)
        start, size = start[some], size[some]
        lists: list[np.ndarray] = [np.zeros(0, np.int32)] * len(some)
        floor = 0
        for width in (4, 8, 12, 16, 24, 32, _MATRIX):
            at = np.flatnonzero((size > floor) & (size <= width))
            floor = width
            if len(at):
                column = np.arange(width)
                grid = self.single[buf[np.minimum(start[at][:, None] + column, len(buf) - 1)]]
                grid[column >= size[at][:, None]] = -1
                for i, ids, n in zip(at.tolist(), (merged := merge_many(self.lexicon, grid)), (merged >= 0).sum(axis=1).tolist()):
                    # A piece that is a token is that token, even if no merges lead to it.
                    whole = self.ranks.get(buf[start[i] : start[i] + size[i]].tobytes())
                    lists[i] = ids[:n] if whole is None else np.array([whole], np.int32)
        for i in np.flatnonzero(size > _MATRIX).tolist():
            lists[i] = np.array(merge(buf[start[i] : start[i] + size[i]].tobytes(), self.ranks), np.int32)
        count = np.array([len(x) for x in lists])
        flat, first = np.concatenate(lists), np.cumsum(count) - count
        many = count[which]
        return flat[np.arange(many.sum()) + np.repeat(first[which] - (np.cumsum(many) - many), many)], many

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each row) of a block of texts."""
        data = buf.tobytes()
        start, pieces = cut(buf, offsets)
        size = np.diff(np.append(start, len(buf)))
        number = look_up(self.lexicon, buf, start, size)
        unseen = np.flatnonzero(number < 0)
        extra, many = self._merged(buf, start[unseen], size[unseen])
        lex = self.lexicon
        known = np.flatnonzero(number >= 0)
        count = np.zeros(len(size), np.int64)
        count[known] = lex.ends[number[known] + 1] - lex.ends[number[known]]
        count[unseen] = many
        to = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), np.int32)

        def spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
            return np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)

        ids[spread(to[known], count[known])] = lex.ids[spread(lex.ends[number[known]].astype(np.int64), count[known])]
        ids[spread(to[unseen], count[unseen])] = extra
        ends = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(pieces)])]
        return ids, np.diff(ends)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of rows of so many ids."""
        first, size = self.ends[ids], self.ends[ids + 1] - self.ends[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)
        return self.bytes[take], ends[np.concatenate([[0], np.cumsum(counts)])]


def _ship(docs: DataFrame, lexicon: Lexicon) -> str:
    """Puts the lexicon's file in the shared folder and has every executor fetch it; its name."""
    spark = docs.sparkSession
    name = f"lexicon-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/{name}")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(where)
    out.write(bytearray(packed(lexicon)))
    out.close()
    fs.deleteOnExit(where)
    spark.sparkContext.addFile(fs.makeQualified(where).toString())
    return name


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = LEXICON_SIZE) -> DataFrame:
    """doc_id, tokens, n_tokens, round_trip for every row of ``docs``: its ids, and whether decoding them gives its text.

    A null text has null tokens, an empty one none (n_tokens 0, round_trip true for both). Special tokens are never
    produced: their strings are ordinary text. Rows that repeat a doc_id are encoded each by its text, rows without
    one as well. An empty table gives an empty one. Other columns, whatever their names, aren't read.
    """
    ranks = read_vocabulary(vocabulary)
    name = _ship(docs, compile_lexicon(frequent_pieces(docs, size), ranks))
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value, mapped(SparkFiles.get(name)))
        for x in batches:
            texts = x.column("text")
            for a, b, buf, offsets in K.text_blocks(texts, lower=False):
                ids, counts = coder.encode(buf, offsets)
                back, ends = coder.decode(ids, counts)
                if len(back) == len(buf) and (back == buf).all() and (ends == offsets).all():
                    same = np.ones(b - a, bool)
                else:
                    same = np.array([np.array_equal(back[ends[i] : ends[i + 1]], buf[offsets[i] : offsets[i + 1]]) for i in range(b - a)], bool)
                tokens = K.list_array(ids, counts, pa.int32())
                tokens = pa.compute.if_else(texts.slice(a, b - a).is_null(), pa.scalar(None, tokens.type), tokens)
                yield pa.RecordBatch.from_arrays([x.column("doc_id").slice(a, b - a), tokens, pa.array(counts), pa.array(same)], ["doc_id", "tokens", "n_tokens", "round_trip"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_batches(slim, run, "doc_id long, tokens array<int>, n_tokens long, round_trip boolean")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text for every row of (doc_id, tokens): the inverse of encode. Null tokens give a null text.

    Ids that aren't whole characters give U+FFFD for what can't be read; an id outside of the vocabulary is an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value, compile_lexicon([], {}))
        for x in batches:
            tokens = x.column("tokens")
            counts = pa.compute.fill_null(pa.compute.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            ids = tokens.flatten().to_numpy(zero_copy_only=False)
            if len(ids) and not (ids.min() >= 0 and ids.max() < len(coder.ends) - 1):
                raise ValueError("an id is not in the vocabulary")
            buf, ends = coder.decode(ids, counts)
            data = buf.tobytes()
            texts = [None if null else data[s:e].decode(errors="replace") for s, e, null in zip(ends[:-1].tolist(), ends[1:].tolist(), tokens.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return in_batches(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "tokens"), run, "doc_id long, text string")
