"""Toxicity classifier learned from confirmed toxic examples and unlabelled text.

Non-negative positive-unlabelled risk (Kiryo et al., 2017), sigmoid loss, linear scores, plain numpy: with class prior
p the risk is p * R_P(+) + max(0, R_U(-) - p * R_P(-)); where the second part falls below zero its gradient is
reversed. A feature is a hashed word or a hashed run of five or seven bytes that a document has once, twice or four
times (the latter two also relative to its length); only those that are clearly more frequent among the positives are
kept, so scoring looks each hash up in one table and counts the few that matter.

The positives are bounded: MOST_POSITIVE confirmed documents, those with the smallest hashes of doc_id. The unlabelled
side is every row with a text: features are counted over all of them, and all of them are in the risk, but that of near
copies in one partition the first stands for all (else a text with thousands of copies would pass for harmless by its
mere number). Trainers (one for every SHARE rows) each minimise the risk of their rows and all positives; their weights
are averaged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymap.llm import kernels as K
from quarrymap.llm.storage import mapped, stored, summed

MOST_POSITIVE = 3000
BUCKETS = 1 << 20
GRAMS = (5, 7)
#: (times, words): a feature of the second and third kind also occurs once in so many words, on average.
LEVELS = ((1, 0), (2, 400), (4, 400))
#: A feature is kept if chance would put so many of its documents among the positives with a probability below
#: exp(-LEAST_EVIDENCE) (Chernoff bound), and if it is LEAST_RATIO times as frequent there as among the negatives that the
#: class prior leaves of the unlabelled. MOST_FEATURES is the size of the model.
LEAST_EVIDENCE, LEAST_RATIO, MOST_FEATURES = 13.0, 4.0, 4096
#: Share of toxic documents; where None it is the share among the audited rows of labels.
PRIOR: float | None = None
#: Unlabelled rows of one trainer.
SHARE = 16384
STEPS, RATE, DECAY, SEED = 400, 0.04, 1e-4, 7
THRESHOLD = 0.5

_CODES = BUCKETS * len(LEVELS)
_FIND = np.uint64(64 - 20)
#: Bytes of text hashed at a time.
_BLOCK = 1 << 19
#: Codes whose counts travel in one row.
_CHUNK = 1 << 16
_GRAM_CODE = {5: np.uint64(0x9E3779B97F4A7C15), 7: np.uint64(0xD6E8FEB86659FD93)}


class Model(NamedTuple):
    """slot: the feature number of each level and bucket, -1 for none; used: buckets that have one at any level."""

    slot: np.ndarray
    used: np.ndarray
    weight: np.ndarray
    bias: float


def _model(features: np.ndarray, weight: np.ndarray, bias: float) -> Model:
    slot = np.full(_CODES, -1, np.int32)
    slot[features] = np.arange(len(features))
    return Model(slot, (slot >= 0).reshape(len(LEVELS), BUCKETS).any(axis=0), weight, bias)


def _grams(buf: np.ndarray, n: int, used: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first byte, bucket) of the runs of n bytes whose bucket is used, a block at a time."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf),), "<u8", padded, 0, (1,))  # the eight bytes from each byte on
    mask = np.uint64((1 << (8 * n)) - 1)
    for lo in range(0, len(buf) - n + 1, _BLOCK):
        bucket = (((eight[lo : min(lo + _BLOCK, len(buf) - n + 1)] & mask) * _GRAM_CODE[n]) >> _FIND).astype(np.int64)
        at = np.flatnonzero(used[bucket])
        yield at + lo, bucket[at]


def hashed(buf: np.ndarray, offsets: np.ndarray, w: K.Words, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, times) of the words and runs of GRAMS bytes within a row whose bucket is used, sorted; words of each row."""
    words = np.bincount(w.row, minlength=len(offsets) - 1)
    bucket = (K.mix64(w.hash ^ np.uint64(0x77)) >> _FIND).astype(np.int64)
    hit = used[bucket]
    if len(offsets) == 2:  # one row, of any length: counted by bucket, a block at a time
        counts = np.bincount(bucket[hit], minlength=BUCKETS)
        for n in GRAMS:
            for _, bucket in _grams(buf, n, used):
                counts += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(counts)
        return np.zeros(len(some), np.int64), some, counts[some], words
    keys = [w.row[hit] * BUCKETS + bucket[hit]]
    for n in GRAMS:
        for at, bucket in _grams(buf, n, used):
            row = np.searchsorted(offsets, at, "right") - 1
            inside = at + n <= offsets[row + 1]
            keys.append(row[inside] * BUCKETS + bucket[inside])
    key = np.sort(np.concatenate(keys))
    starts, key = K.segments(key)
    return key // BUCKETS, key % BUCKETS, np.diff(np.append(starts, sum(map(len, keys)))), words


def levelled(row: np.ndarray, bucket: np.ndarray, times: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, level * BUCKETS + bucket) of each feature that a row has; sorted by row."""
    rows, codes = [], []
    for level, (least, spread) in enumerate(LEVELS):
        hit = (times >= least) & (times * spread >= words[row] if spread else True)
        rows.append(row[hit])
        codes.append(level * BUCKETS + bucket[hit])
    row, code = np.concatenate(rows), np.concatenate(codes)
    order = np.argsort(row, kind="stable")
    return row[order], code[order]


class Block(NamedTuple):
    """Rows first to last - 1 of an Arrow column, with their words."""

    first: int
    last: int
    buf: np.ndarray
    offsets: np.ndarray
    words: K.Words

    def features(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, code), sorted by row, of the buckets that are used."""
        return levelled(*hashed(self.buf, self.offsets, self.words, used))


def _blocks(texts: pa.Array) -> Iterator[Block]:
    for a, b, buf, offsets in K.text_blocks(texts, limit=_BLOCK):
        yield Block(a, b, buf, offsets, K.words(buf, offsets))


class Unseen:
    """Which rows have no near copy among those before: none with an equal band of 4 minima over runs of three words."""

    BANDS = 4

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def __call__(self, block: Block) -> np.ndarray:
        rows = block.last - block.first
        row, code = K.shingles(block.words, rows, 3)
        starts, some = K.segments(row)
        marks = np.broadcast_to(np.arange(self.BANDS, dtype=np.uint64), (len(some), self.BANDS))
        for k in range(4 if len(row) else 0):
            low = [np.minimum.reduceat(K.mix64(code * _ODD[4 * band + k]), starts) for band in range(self.BANDS)]
            marks = K.mix64(marks * np.uint64(31) + np.stack(low, axis=1))
        new = np.ones(rows, bool)
        for i, mine in zip(some.tolist(), marks.tolist()):
            new[i] = self.seen.isdisjoint(mine)
            self.seen.update(mine)
        return new


#: Near copies among the positives would make features of what only their common text has: marks are MARKS bands of 4 minima.
MARKS = 16
_ODD = np.random.default_rng(SEED).integers(1, 2**63, 4 * MARKS, dtype=np.uint64) | np.uint64(1)


def _packed(row: np.ndarray, values: np.ndarray, rows: int) -> pa.Array:
    """The values of each row (sorted) as bytes."""
    ends = (np.searchsorted(row, np.arange(rows + 1)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())])


def _presence(docs: DataFrame) -> DataFrame:
    """id, bag (the codes as uint32), marks (hash pairs that near copies share) of each (id, text)."""
    all_used = np.ones(BUCKETS, bool)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for block in _blocks(x.column("text")):
                (a, b), (row, bucket) = block[:2], block.features(all_used)
                starts, some = K.segments(row)
                low = np.zeros((b - a, 4 * MARKS), np.uint64)
                code = K.mix64(bucket.astype(np.uint64) + np.uint64(1))
                for k in range(4 * MARKS if len(row) else 0):
                    low[some, k] = np.minimum.reduceat(K.mix64(code * _ODD[k]), starts)
                marks = np.broadcast_to(np.arange(MARKS, dtype=np.uint64), (b - a, MARKS))
                for k in range(4):
                    marks = K.mix64(marks * np.uint64(31) + low[:, k::4])
                yield pa.RecordBatch.from_arrays([x.column("id").slice(a, b - a), _packed(row, bucket.astype(np.uint32), b - a), K.list_array(marks.view(np.int64).ravel(), np.full(b - a, MARKS), pa.int64())], ["id", "bag", "marks"])

    return mapped(docs, bags, "id long, bag binary, marks array<long>")


def _without_copies(marked: list[tuple[int, list[int]]]) -> set[int]:
    """The ids of (id, marks), in order, that share no mark with an earlier one."""
    seen: set[tuple[int, int]] = set()
    kept = set()
    for row_id, marks in sorted(marked):
        keys = set(enumerate(marks))
        if not keys & seen:
            kept.add(row_id)
        seen |= keys
    return kept


def _chunks(counts: np.ndarray, kind: type) -> Iterator[pa.RecordBatch]:
    """(k, part, w) of the chunks of an array that aren't all 0."""
    part = TaskContext.get().partitionId() % 64
    for lo in range(0, len(counts), _CHUNK):
        piece = counts[lo : lo + _CHUNK]
        if piece.any():
            yield pa.RecordBatch.from_arrays([pa.array([lo // _CHUNK]), pa.array([part]), pa.array([piece.astype(kind).tobytes()], pa.binary())], ["k", "part", "w"])


def _joined(chunks: dict[int, np.ndarray], size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for k, piece in chunks.items():
        out[k * _CHUNK :][: len(piece)] = piece
    return out


def positive_counts(sample: DataFrame, kept: set[int]) -> np.ndarray:
    """In how many of the kept rows of the sample each code occurs."""
    shared = sample.sparkSession.sparkContext.broadcast(kept)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_CODES, np.int32)
        for x in batches:
            for row_id, bag in zip(x.column("id").to_pylist(), x.column("bag")):
                if row_id in shared.value:
                    counts[np.frombuffer(bag.as_buffer(), np.uint32)] += 1
        yield from _chunks(counts, np.uint16)

    found = summed(mapped(sample.select("id", "bag"), count, "k long, part long, w binary"), np.uint16, np.int64)
    shared.unpersist()
    return _joined(found, _CODES)


def unlabelled_counts(texts: DataFrame, candidates: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many rows of ``texts`` each candidate code occurs, and how many rows count (of near copies in a partition one)."""
    n = len(candidates)
    number = np.full(_CODES, -1, np.int32)
    number[candidates] = np.arange(n)
    shared = texts.sparkSession.sparkContext.broadcast((number, (number >= 0).reshape(len(LEVELS), BUCKETS).any(axis=0)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, used = shared.value
        counts, unseen = np.zeros(n + 1, np.int64), Unseen()
        for x in batches:
            for block in _blocks(x.column("text")):
                new = unseen(block)
                row, code = block.features(used)
                at = number[code[new[row]]]
                counts[:n] += np.bincount(at[at >= 0], minlength=n)
                counts[n] += new.sum()
        yield from _chunks(counts, np.uint32)

    found = _joined(summed(mapped(texts.select("text"), count, "k long, part long, w binary"), np.uint32, np.int64), n + 1)
    shared.unpersist()
    return found[:n], int(found[n])


def _evidence(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """How surprising it is that p of the p + u rows with a feature are positives, where n_p of n_p + n_u are."""
    base, share = n_p / (n_p + n_u), np.clip(p / np.maximum(1, p + u), 1e-9, 1 - 1e-9)
    return np.where(share > base, (p + u) * (share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base))), 0.0)


def strong(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int, prior: float) -> np.ndarray:
    """Places of the features that count, strongest first; p, u: rows that have each, of n_p positives and n_u others."""
    negative = np.maximum(0.5 / n_u, u / n_u - prior * p / n_p) / (1 - prior)
    evidence = _evidence(p, u, n_p, n_u)
    good = np.flatnonzero((evidence >= LEAST_EVIDENCE) & (p / n_p >= LEAST_RATIO * negative))
    return good[np.lexsort((good, -evidence[good]))][:MOST_FEATURES]


class Bags(NamedTuple):
    """Rows as lists of feature numbers: owner and number of each entry, and how often each row counts."""

    owner: np.ndarray
    number: np.ndarray
    times: np.ndarray


def bags_of(rows: dict[bytes, int]) -> Bags:
    """rows: uint16 feature numbers as bytes, and how often they occur."""
    keys = sorted(rows)
    lengths = np.array([len(k) // 2 for k in keys], np.int64)
    return Bags(np.repeat(np.arange(len(keys)), lengths), np.frombuffer(b"".join(keys), np.uint16).astype(np.int64), np.array([rows[k] for k in keys], np.float64))


def risk_gradient(p_margin: np.ndarray, p_times: np.ndarray, u_margin: np.ndarray, u_times: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the non-negative risk by each row's score: of the positive rows, of the unlabelled rows."""
    s_p, s_u = (1 / (1 + np.exp(-np.clip(m, -40, 40))) for m in (p_margin, u_margin))
    n_p, n_u = p_times.sum(), u_times.sum()
    g_p, g_u = s_p * (1 - s_p) * p_times / n_p, s_u * (1 - s_u) * u_times / n_u
    if (s_u @ u_times) / n_u >= prior * (s_p @ p_times) / n_p:
        return -2 * prior * g_p, g_u
    return prior * g_p, -g_u


def fit(positive: Bags, unlabelled: Bags, features: int, prior: float) -> tuple[np.ndarray, float]:
    """(weights, bias) by Adam on the non-negative risk."""
    weight, bias = np.zeros(features), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(features + 1), np.zeros(features + 1)
    for step in range(1, STEPS + 1):
        margins = [np.bincount(b.owner, weights=weight[b.number], minlength=len(b.times)) + bias for b in (positive, unlabelled)]
        g = risk_gradient(margins[0], positive.times, margins[1], unlabelled.times, prior)
        grad = DECAY * weight
        for b, rows in zip((positive, unlabelled), g):
            grad = grad + np.bincount(b.number, weights=rows[b.owner], minlength=features)
        grad = np.append(grad, g[0].sum() + g[1].sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    return weight, bias


def featured(docs: DataFrame, features: np.ndarray) -> DataFrame:
    """doc_id, turn (a number within the partition), counts (whether there is a text and no near copy before), at (numbers of its features) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(_model(features, np.zeros(0), 0.0))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, turn, unseen = shared.value, 0, Unseen()
        for x in batches:
            for block in _blocks(x.column("text")):
                (a, b), (row, code) = block[:2], block.features(m.used)
                at = m.slot[code]
                row, at = row[at >= 0], at[at >= 0]
                order = np.lexsort((at, row))
                counts = x.column("text").slice(a, b - a).is_valid().to_numpy(zero_copy_only=False) & unseen(block)
                yield pa.RecordBatch.from_arrays([x.column("doc_id").slice(a, b - a), pa.array(np.arange(turn, turn + b - a)), pa.array(counts), _packed(row[order], at[order].astype(np.uint16), b - a)], ["doc_id", "turn", "counts", "at"])
                turn += b - a

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), look, "doc_id long, turn long, counts boolean, at binary")


def _averaged(rows: DataFrame, positive: Bags, features: int, prior: float, n: int) -> tuple[np.ndarray, float]:
    """What the trainers of the unlabelled rows (doc_id, turn, at) find, averaged by their numbers of rows."""
    trainers = max(1, round(n / SHARE))
    fan = math.isqrt(trainers) + 1
    shared = rows.sparkSession.sparkContext.broadcast(positive)

    def work(table: pa.Table) -> pa.Table:
        bags = bags_of(Counter(b.as_buffer().to_pybytes() for b in table.column("at")))
        weight, bias = fit(shared.value, bags, features, prior)
        made = np.concatenate([weight, [bias, 1.0]]) * table.num_rows
        return pa.table({"k": pa.array([0]), "part": pa.array([table.column("deal")[0].as_py() % fan]), "w": pa.array([made.tobytes()], pa.binary())})

    # The number within the partition deals repeated rows, of which there may be any number, to all trainers.
    dealt = rows.select("at", F.pmod(F.xxhash64("doc_id", "turn", F.lit(SEED)), F.lit(trainers)).alias("deal"))
    total = summed(dealt.groupBy("deal").applyInArrow(work, "k long, part long, w binary"), np.float64, np.float64)[0]
    shared.unpersist()
    return total[:-2] / total[-1], float(total[-2] / total[-1])


def train(docs: DataFrame, labels: DataFrame, prior: float | None = PRIOR) -> tuple[Model, DataFrame | None]:
    """The model, and the stored features of every row (``featured``; None where there are no positives to learn from).

    Positives are rows that ``labels`` confirms; every row with a text is unlabelled, whatever else is known of it, and
    features are counted among those that aren't in the sample of positives. The driver gets counts by code, marks of
    the positives and weights; none of them grows with the table.
    """
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    audited = marks.agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).first()
    if prior is None:
        prior = (audited["p"] or 0) / audited["n"] if audited["n"] else 0.0
    prior = min(0.9, max(0.001, float(prior)))
    none = _model(np.zeros(0, np.int64), np.zeros(0), -10.0)
    named = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text")
    chosen = marks.filter("toxic = 1").select("id").join(named.select("id"), "id", "left_semi").orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(MOST_POSITIVE)
    # Of rows that repeat a doc_id the least text counts. At most MOST_POSITIVE ids are broadcast.
    texts = named.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"))
    sample = stored(_presence(texts), "bags")
    marked = [(r["id"], r["marks"]) for r in sample.select("id", "marks").toLocalIterator()]
    kept = _without_copies(marked)
    n_p, texts = len(kept), docs.filter("text IS NOT NULL")
    n_all = texts.count()
    if not n_p or n_all <= n_p:
        return none, None
    p = positive_counts(sample, kept)
    candidates = np.flatnonzero(_evidence(p, np.zeros(len(p)), n_p, n_all - n_p) >= LEAST_EVIDENCE)
    # The kept positives, which are no near copies of one another, are among the rows that count.
    u, n_u = unlabelled_counts(texts, candidates)
    features = candidates[strong(p[candidates], np.maximum(u - p[candidates], 0), n_p, max(1, n_u - n_p), prior)]
    if not len(features):
        return none, None
    rows = stored(featured(docs, features), "features")
    mine = _positive_bags(sample, kept, features)
    weight, bias = _averaged(rows.filter("counts"), mine, len(features), prior, n_u)
    return _model(features, weight, bias), rows


def _positive_bags(sample: DataFrame, kept: set[int], features: np.ndarray) -> Bags:
    """The features of the kept positives; only their numbers come to the driver."""
    shared = sample.sparkSession.sparkContext.broadcast((_model(features, np.zeros(0), 0.0).slot, kept))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, wanted = shared.value
        for x in batches:
            at = [slot[np.frombuffer(bag.as_buffer(), np.uint32)] for i, bag in zip(x.column("id").to_pylist(), x.column("bag")) if i in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([np.sort(a[a >= 0]).astype(np.uint16).tobytes() for a in at], pa.binary())], ["at"])

    return bags_of(Counter(bytes(r["at"]) for r in mapped(sample.select("id", "bag"), look, "at binary").toLocalIterator()))


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-margin))


def scores(row: np.ndarray, code: np.ndarray, rows: int, model: Model) -> np.ndarray:
    """Probability of each row of a block from its features."""
    at = model.slot[code]
    row, at = row[at >= 0], at[at >= 0]
    return _probability(np.bincount(row, weights=model.weight[at], minlength=rows) + model.bias)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, is_toxic (score >= THRESHOLD) for every row of ``docs``.

    Null and empty texts have no feature and get the base score, which is below THRESHOLD; so has every row where
    ``labels`` confirms nothing. Rows that repeat a doc_id are scored each by its text, rows without one as well. Null
    toxic marks count as not confirmed; a doc_id with several marks is confirmed by any. An empty table gives an empty
    one. Other columns, whatever their names, aren't read.
    """
    model, rows = train(docs, labels)
    if rows is None:
        score = F.lit(float(_probability(np.array(model.bias))))
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), score.alias("score"), F.lit(False).alias("is_toxic"))
    weight, bias = model.weight, model.bias

    def score_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            at = [np.frombuffer(b.as_buffer(), np.uint16) for b in x.column("at")]
            made = _probability(np.array([weight[a].sum() for a in at]) + bias)
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(made), pa.array(made >= THRESHOLD)], ["doc_id", "score", "is_toxic"])

    return mapped(rows.select("doc_id", "at"), score_of, "doc_id long, score double, is_toxic boolean")


def keep_harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that classify finds toxic; all columns as they are, in order.

    Null, empty and very long texts, repeated rows, rows without doc_id and an empty table count as in classify.
    """
    model, _ = train(docs, labels)
    if not len(model.weight):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct("*").alias("row"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for x in batches:
            rows = x.column("row")
            parts = [scores(*block.features(m.used), block.last - block.first, m) for block in _blocks(rows.field("text"))]
            if parts:
                yield pa.RecordBatch.from_arrays([rows.filter(pa.array(np.concatenate(parts) < THRESHOLD))], ["row"])

    return mapped(packed, keep, packed.schema).select("row.*")
