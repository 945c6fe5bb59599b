"""Log-likelihood of whole documents under a gated recurrent language model.

Tokens are words (``kernels``) and an end of text. The vocabulary is the most frequent words, counted over all
documents; any other word is UNKNOWN in the model and spelled by a byte-bigram model, whose counts are also taken over
all documents, so that every word has a probability. The network is one GRU layer; its softmax is factored by classes
of CLASS words of neighbouring frequency: P(word) = P(class) * P(word | class).

Training: every document is cut into stretches of STRETCH words, all of which are dealt to the trainers. Trainers (their
number grows with the words) run Adam with truncated backpropagation over windows of WINDOW words, carrying the state
from one window of a stretch to the next, and their weights are averaged after each of TURNS turns.

Scoring: every document is read from its first word to its last, in windows, with the state carried across them.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymap.llm import kernels as K
from quarrymap.llm.storage import mapped, stored, summed

VOCABULARY, CLASS = 4096, 64
HIDDEN = 32
UNKNOWN, END = 0, 1
WINDOW, STRETCH = 32, 256
TURNS, RATE, SEED = 3, 0.01, 11
#: Stretches of one trainer in one turn, and how many batches it cuts them into; so at every size each word is trained on
#: once, in as many steps.
SHARE, BATCHES = 8192, 32
#: Rows that are scored at the same time, tokens whose rows share the lanes, and states whose words are scored at once.
LANES, _SCORED_TOKENS, _OUTPUT_ROWS = 256, 3 << 19, 16384
#: Weights that are moved at a time, steps whose factors are made at a time, and rows that are taken through the softmaxes
#: at a time. From _OFTEN rows on, a token's are summed by a product.
_PIECE, _STEPS, _BLOCK, _OFTEN = 1 << 14, 4, 1024, 24


class Model(NamedTuple):
    emb: np.ndarray  # vocabulary x 3H: what a word adds to the gates z, r and to the candidate n
    rec: np.ndarray  # H x 3H
    bias: np.ndarray  # 3H
    to_class: np.ndarray  # H x classes
    class_bias: np.ndarray
    to_word: np.ndarray  # classes x H x CLASS
    word_bias: np.ndarray  # classes x CLASS


def initial(words: int = VOCABULARY, hidden: int = HIDDEN) -> Model:
    rng = np.random.default_rng(SEED)
    classes = -(-words // CLASS)
    normal = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    zero = lambda *shape: np.zeros(shape, np.float32)
    return Model(normal(words, 3 * hidden), normal(hidden, 3 * hidden), zero(3 * hidden), normal(hidden, classes), zero(classes), normal(classes, hidden, CLASS), zero(classes, CLASS))


#: Gates are 1 / (1 + exp(-a)), and n is 1 - 2 / (1 + exp(2a)): weights are scaled beforehand, so that exp comes next.
_SCALE = (-1.0, -1.0, 2.0)


def by_gate(weights: np.ndarray) -> np.ndarray:
    """The last axis, 3H, as a first one of the gates z, r and of n, scaled by _SCALE."""
    parts = np.moveaxis(weights.reshape(*weights.shape[:-1], 3, -1), -2, 0)
    return np.stack([part * weights.dtype.type(k) for part, k in zip(parts, _SCALE)])


def step(rec: np.ndarray, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(next state, what the state adds to n, twice) after inputs x, by gate as rec is, from state h; z, r and n themselves are left in x.

    An exp that overflows gives a gate of 0 and an n of 1, as it should.
    """
    u = np.matmul(h, rec)
    gates, n = x[:2], x[2]
    gates += u[:2]
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    back = u[2]
    n += gates[1] * back
    np.exp(n, out=n)
    n += 1
    np.divide(-2, n, out=n)
    n += 1
    out = h - n
    out *= gates[0]
    out += n
    return out, back


def _small(m: Model) -> bool:
    """Whether no logit can leave -60 to 60, as states lie between -1 and 1."""
    return max((np.abs(m.to_class).sum(axis=0) + np.abs(m.class_bias)).max(), (np.abs(m.to_word).sum(axis=1) + np.abs(m.word_bias)).max()) <= 60


def _with_ones(states: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Those rows of the states, and a column of ones, by which biases are a row of the weights."""
    out = np.ones((len(at), states.shape[1] + 1), states.dtype)
    out[:, :-1] = np.take(states, at, axis=0)
    return out


def joined(m: Model, out: np.ndarray | None = None) -> np.ndarray:
    """For each class the weights of all classes' logits beside those of its own words' logits, so that one product gives both; biases are the last row."""
    classes = len(m.class_bias)
    out = np.empty((classes, len(m.rec) + 1, classes + CLASS), m.rec.dtype) if out is None else out
    out[:, :-1, :classes], out[:, -1, :classes] = m.to_class, m.class_bias
    out[:, :-1, classes:], out[:, -1, classes:] = m.to_word, m.word_bias
    return out


class Softmaxes(NamedTuple):
    """Rows that fit into the processor's cache, through the softmaxes of their classes and of their words."""

    rows: slice
    runs: list[tuple[int, int, int]]  # first row of the block, last row + 1, class
    exp: np.ndarray  # exp of the logits, as joined has them; its next block overwrites it
    total: np.ndarray  # sum of exp by row and softmax
    parts: np.ndarray  # which of the two softmaxes a column is of
    own: np.ndarray  # where exp has each row's own class and word, in the flat array
    logit: np.ndarray  # the logits there; logits that aren't small are shifted so that none overflows


def softmaxes(weight: np.ndarray, states: np.ndarray, target: np.ndarray, small: bool) -> Iterator[Softmaxes]:
    """All rows, which are sorted by class, in blocks of _BLOCK; states have a column of ones."""
    classes, width = len(weight), weight.shape[2]
    halves = (slice(classes), slice(classes, width))
    group = target // CLASS
    own = np.arange(len(target))[:, None] % _BLOCK * width + np.stack([group, classes + target % CLASS], axis=1)
    room, parts = np.empty((min(_BLOCK, len(target)), width), states.dtype), np.zeros((width, 2), states.dtype)
    parts[halves[0], 0] = parts[halves[1], 1] = 1
    for lo in range(0, len(target), _BLOCK):
        rows = slice(lo, min(lo + _BLOCK, len(target)))
        starts, which = K.segments(group[rows])
        logits, at = room[: rows.stop - lo], own[rows]
        runs = list(zip(starts.tolist(), [*starts[1:].tolist(), len(logits)], which.tolist()))
        for s, e, c in runs:
            np.matmul(states[lo + s : lo + e], weight[c], out=logits[s:e])
        if not small:
            for half in halves:
                logits[:, half] -= logits[:, half].max(axis=1, keepdims=True)
        logit = logits.reshape(-1)[at]
        np.exp(logits, out=logits)
        yield Softmaxes(rows, runs, logits, logits @ parts, parts, at, logit)


def log_probabilities(m: Model, h: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Log probability of each target from its state; weight: as joined gives it, where that is known."""
    order = np.argsort((target // CLASS).astype(np.uint16), kind="stable")
    got = np.empty(len(h))
    for x in softmaxes(joined(m) if weight is None else weight, _with_ones(h, order), target[order], _small(m)):
        got[x.rows] = x.logit.sum(axis=1, dtype=np.float64) - np.log(x.total).sum(axis=1, dtype=np.float64)
    out = np.empty(len(h))
    out[order] = got
    return out


def _by_token(tokens: np.ndarray, rows: np.ndarray, n: int, out: np.ndarray | None = None) -> np.ndarray:
    """The rows summed by token, of which there are n; frequent ones each by one product, the others' first rows at once, then their second ones and so on."""
    out = np.empty((n, rows.shape[1]), rows.dtype) if out is None else out
    out[...] = 0
    order = np.argsort(tokens.astype(np.uint16), kind="stable")  # short numbers are sorted by digits, which is faster
    starts, which = K.segments(tokens[order])
    size = np.diff(starts, append=len(tokens))
    by_size = np.argsort(-size, kind="stable")
    first, many, token = starts[by_size], size[by_size], which[by_size]
    often = int(np.searchsorted(-many, -_OFTEN, "right"))
    ones = np.ones(int(many[0]) if len(many) else 0, rows.dtype)
    for s, k, t in zip(first[:often].tolist(), many[:often].tolist(), token[:often].tolist()):
        np.matmul(ones[:k], np.take(rows, order[s : s + k], axis=0), out=out[t])
    first, many = first[often:], many[often:]
    if len(many):
        total = np.take(rows, order[first], axis=0)
        for k, left in enumerate(np.searchsorted(-many, -np.arange(1, int(many[0])), "left").tolist(), 1):
            total[:left] += np.take(rows, order[first[:left] + k], axis=0)
        out[token[often:]] = total
    return out


class Room:
    """Arrays that one window after the other works in, as new memory costs as much as what is done in it. What is in them is left over."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, dtype: np.dtype, *shape: int) -> np.ndarray:
        n = math.prod(shape)
        if name not in self.held or len(self.held[name]) < n:
            self.held[name] = np.empty(n, dtype)
        return self.held[name][:n].reshape(shape)


def gradients(m: Model, h0: np.ndarray, tokens: np.ndarray, targets: np.ndarray, live: np.ndarray, lossy: bool = True, into: Model | None = None, room: Room | None = None) -> tuple[list[np.ndarray], np.ndarray, float]:
    """(gradient of each array, last state, summed loss if ``lossy``) of one window: tokens and targets are steps x rows.

    live: how many rows, counted from the first, each step has; it never grows. Backpropagation stops at h0, the state
    that the window before left. The gradient is written into the arrays of ``into``, where that is given; a ``room`` is
    for windows of one kind of number.
    """
    steps, rows = tokens.shape
    size, small, kind, room = h0.shape[1], _small(m), h0.dtype, room or Room()
    emb = room("emb", kind, 3, len(m.emb), size)
    for k, by in enumerate(_SCALE):
        part = slice(k * size, (k + 1) * size)
        np.add(m.emb[:, part], m.bias[part], out=emb[k])
        emb[k] *= kind.type(by)
    x, rec = room("x", kind, 3, steps, rows, size), by_gate(m.rec)
    np.take(emb, tokens, axis=1, out=x, mode="clip")
    hs, back = room("hs", kind, steps + 1, rows, size), room("back", kind, steps, rows, size)
    hs[0] = h0
    with np.errstate(over="ignore"):
        for t in range(steps):
            k = live[t]
            hs[t + 1, :k], back[t, :k] = step(rec, hs[t, :k], x[:, t, :k])
            hs[t + 1, k:], back[t, k:] = hs[t, k:], 0
    on = np.concatenate([np.arange(k) + t * rows for t, k in enumerate(live)])
    target = targets.ravel()[on]
    scale, classes = kind.type(1 / max(1, len(on))), len(m.class_bias)
    order = np.argsort((target // CLASS).astype(np.uint16), kind="stable")
    at, target = on[order], target[order]
    states = room("states", kind, len(on), size + 1)
    states[:, :-1], states[:, -1] = np.take(hs[1:].reshape(-1, size), at, axis=0), 1
    weight = joined(m, room("weight", kind, classes, size + 1, classes + CLASS))
    g_out, d_out, seen, loss = room("g_out", kind, *weight.shape), room("d_out", kind, len(on), size), -1, 0.0
    g_out[...] = 0
    for block in softmaxes(weight, states, target, small):
        lo, q = block.rows.start, block.exp
        if lossy:
            loss += float(np.log(block.total).sum(dtype=np.float64)) - float(block.logit.sum(dtype=np.float64))
        q.reshape(-1)[block.own] -= block.total
        q *= (scale / block.total) @ block.parts.T
        for s, e, c in block.runs:
            if c == seen:  # the block before ended within this class
                g_out[c] += states[lo + s : lo + e].T @ q[s:e]
            else:
                np.matmul(states[lo + s : lo + e].T, q[s:e], out=g_out[c])
            np.matmul(q[s:e], weight[c, :-1].T, out=d_out[lo + s : lo + e])
            seen = c
    d_states = room("d_states", kind, steps * rows, size)
    if len(on) < len(d_states):
        d_states[...] = 0
    d_states[at] = d_out
    d_states = d_states.reshape(steps, rows, size)
    d_u, d_n = room("d_u", kind, steps, rows, 3, size), room("d_n", kind, steps, rows, size)
    d, to_state = np.zeros((rows, size), kind), np.ascontiguousarray(m.rec.T)
    half = kind.type(0.5)
    # All that comes of a step's gradient d is a factor of the forward pass by d; factors are made of several steps at once.
    for hi in range(steps, 0, -_STEPS):
        part = slice(max(0, hi - _STEPS), hi)
        z, r, n = x[:, part]
        by_n = (1 - n * n) * (1 - z)
        factor = room("factor", kind, len(z), rows, 3, size)
        np.multiply((hs[part] - n) * z, 1 - z, out=factor[:, :, 0])
        by_r = by_n * r
        factor[:, :, 2] = by_r
        np.multiply(by_r * (1 - r), back[part] * half, out=factor[:, :, 1])
        for t in range(hi - 1, part.start - 1, -1):
            k = live[t]
            mine, out = d[:k], d_u[t, :k]
            mine += d_states[t, :k]
            d_n[t, :k] = mine
            d_u[t, k:], d_n[t, k:] = 0, 0
            np.multiply(factor[t - part.start, :k], mine[:, None], out=out)
            mine *= z[t - part.start, :k]
            mine += out.reshape(k, -1) @ to_state
        d_n[part] *= by_n
    flat = d_u.reshape(-1, 3 * size)
    out = Model(*map(np.empty_like, m)) if into is None else into
    np.matmul(hs[:-1].reshape(-1, size).T, flat, out=out.rec)
    flat[:, 2 * size :] = d_n.reshape(-1, size)
    _by_token(tokens.ravel(), flat, len(m.emb), out.emb)
    np.matmul(np.ones(len(flat), kind), flat, out=out.bias)
    g_class = g_out[:, :, :classes].sum(axis=0)
    out.to_class[...], out.class_bias[...] = g_class[:-1], g_class[-1]
    out.to_word[...], out.word_bias[...] = g_out[:, :-1, classes:], g_out[:, -1, classes:]
    return list(out), hs[-1].copy(), loss


def train_on(m: Model, stretches: np.ndarray, lengths: np.ndarray, seed: int) -> Model:
    """Adam over BATCHES batches of the stretches (rows of token ids, lengths of them used), each seen once."""
    weights = np.concatenate([w.ravel() for w in m])
    now = _shaped(weights, m)
    first, second, grad, count = np.zeros_like(weights), np.zeros_like(weights), np.empty_like(weights), 0
    parts, room = _shaped(grad, m), Room()
    order = np.random.default_rng(seed).permutation(len(stretches))
    for at in np.array_split(order, min(BATCHES, len(order))):
        at = at[np.argsort(-lengths[at], kind="stable")]
        ids, many = np.ascontiguousarray(stretches[at].T.astype(np.int64)), lengths[at]
        h = np.zeros((len(at), m.rec.shape[0]), np.float32)
        before = np.vstack([np.full((1, len(at)), END), ids[:-1]])
        for w in range(0, int(many.max()), WINDOW):
            to = min(w + WINDOW, int(many.max()))
            live = np.searchsorted(-many, -np.arange(w, to), "left")  # the longest come first
            some = live[0]
            _, h, _ = gradients(now, h[:some], before[w:to, :some], ids[w:to, :some], live, lossy=False, into=parts, room=room)
            count += 1
            clip = min(1.0, 1.0 / max(float(np.sqrt(grad @ grad)), 1e-9))
            _adam(weights, grad, first, second, clip, RATE * np.sqrt(1 - 0.99**count) / (1 - 0.9**count))
    return now


def _shaped(flat: np.ndarray, like: Model) -> Model:
    """The arrays of a model as views of one."""
    return Model(*(part.reshape(w.shape) for part, w in zip(np.split(flat, np.cumsum([w.size for w in like])[:-1]), like)))


def _adam(weights: np.ndarray, grad: np.ndarray, first: np.ndarray, second: np.ndarray, clip: float, rate: float) -> None:
    """One step in place, a piece that fits into the processor's cache at a time; what is in grad is lost.

    first and second are 10 and 100 times Adam's running means, so that a gradient is added to them as it is.
    """
    of = weights.dtype.type
    for lo in range(0, len(weights), _PIECE):
        w, g, a, b = (x[lo : lo + _PIECE] for x in (weights, grad, first, second))
        if clip < 1:
            g *= of(clip)
        a *= of(0.9)
        a += g
        g *= g
        b *= of(0.99)
        b += g
        np.sqrt(b, out=g)
        g += of(1e-5)
        np.divide(a, g, out=g)
        g *= of(rate)
        w -= g


class Corpus(NamedTuple):
    """What is counted over all documents: hashes of the vocabulary's words, sorted, their ids, and spelling."""

    hashes: np.ndarray
    ids: np.ndarray
    spelling: np.ndarray  # log probability of a byte after another; 0 is the end (and the start) of a word
    unigram: np.ndarray  # log share of each token id, where a model starts from


def counts(docs: DataFrame) -> Corpus:
    """Vocabulary and byte bigrams (over the bytes of every occurrence of every word)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(65536, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            code, place = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            n = np.bincount(place, weights=np.concatenate([c for _, c in held])).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], ["code", "n"])

        for x in batches:
            for _, _, buf, offsets in K.text_blocks(x.column("text")):
                w = K.words(buf, offsets)
                held.append(np.unique(w.hash, return_counts=True))
                pairs += _pair_counts(buf, w)
                if len(held) >= 16:
                    yield flush()
        if held:
            yield flush()
        some = np.flatnonzero(pairs)
        # Byte pairs travel as codes -65536 to -1 among the words' hashes, of which one in 2**48 would be taken for one.
        yield pa.RecordBatch.from_arrays([pa.array(-1 - some), pa.array(pairs[some])], ["code", "n"])

    rows = mapped(docs.filter("text IS NOT NULL").select("text"), count, "code long, n long")
    tallied = stored(rows.groupBy("code").agg(F.sum("n").alias("n")), "counts")
    small = (F.col("code") < 0) & (F.col("code") >= -65536)
    pairs = np.zeros(65536)
    for code, n in tallied.filter(small).toLocalIterator():
        pairs[-1 - code] = n
    spell = (pairs.reshape(256, 256) + 0.01) / (pairs.reshape(256, 256) + 0.01).sum(axis=1, keepdims=True)
    words = tallied.filter(~small)
    total = words.agg(F.sum("n")).first()[0] or 0
    top = words.orderBy(F.desc("n"), "code").limit(VOCABULARY - 2).collect()
    codes, n = np.array([r["code"] for r in top], np.int64).view(np.uint64), np.array([r["n"] for r in top], np.float64)
    order = np.argsort(codes)
    documents = docs.filter("text IS NOT NULL").count()
    share = np.full(VOCABULARY, 0.5)
    share[UNKNOWN], share[END] = max(0.5, total - n.sum()), max(0.5, documents)
    share[2 : 2 + len(n)] = n
    return Corpus(codes[order], (order + 2).astype(np.int32), np.log(spell).astype(np.float64), np.log(share / share.sum()))


def _pair_counts(buf: np.ndarray, w: K.Words) -> np.ndarray:
    """Counts of (byte before, byte) within words, with 0 before and after."""
    if not len(w.start):
        return np.zeros(65536, np.int64)
    byte = np.zeros(len(buf) + 2, np.int64)
    change = np.zeros(len(buf) + 1, np.int8)
    change[w.start] = 1
    change[w.end] -= 1  # no two words end at the same place
    byte[1:-1] = buf * (np.cumsum(change[:-1], dtype=np.int8) > 0)
    pairs = np.bincount((byte[:-1] << 8) + byte[1:], minlength=65536)
    pairs[0] = 0
    # Where one row's last word meets the next row's first, the two have no byte between them.
    met = w.start[1:][w.start[1:] == w.end[:-1]]
    last, next_ = buf[met - 1].astype(np.int64), buf[met].astype(np.int64)
    np.subtract.at(pairs, last * 256 + next_, 1)
    np.add.at(pairs, last * 256, 1)
    np.add.at(pairs, next_, 1)
    return pairs


def tokens(buf: np.ndarray, w: K.Words, corpus: Corpus) -> np.ndarray:
    if not len(corpus.hashes):
        return np.full(len(w.hash), UNKNOWN, np.int32)
    # Hashes are spread evenly, so few begin with the same 16 bits: those are compared one after the other.
    begin = np.searchsorted(corpus.hashes >> np.uint64(48), np.arange(65537, dtype=np.uint64)).astype(np.int32)
    hashes, ids = np.append(corpus.hashes, corpus.hashes[-1]), np.append(corpus.ids, corpus.ids[-1])
    at, out = begin[w.hash >> np.uint64(48)], np.full(len(w.hash), UNKNOWN, np.int32)
    for k in range(int(np.diff(begin).max())):
        near = np.minimum(at + k, len(corpus.hashes)) if k else at
        np.copyto(out, ids[near], where=hashes[near] == w.hash)
    return out


def spelled(buf: np.ndarray, w: K.Words, unknown: np.ndarray, corpus: Corpus) -> np.ndarray:
    """Log probability of the bytes of each unknown word."""
    start, end = w.start[unknown], w.end[unknown]
    inside = np.zeros(max(1, len(buf)))
    np.cumsum(np.take(corpus.spelling, (buf[:-1].astype(np.uint16) << 8) + buf[1:]), out=inside[1:])
    return corpus.spelling[0, buf[start]] + inside[end - 1] - inside[start] + corpus.spelling[buf[end - 1], 0]


def token_table(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """(doc_id, key, ids, n_unknown, spelled) of every row: its token ids as bytes (null of a null text), and what its unknown words' spelling adds; key stands for a null doc_id, too."""
    shared = docs.sparkSession.sparkContext.broadcast(corpus)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for x in batches:
            for a, b, buf, offsets in K.text_blocks(x.column("text")):
                w = K.words(buf, offsets)
                token = tokens(buf, w, c)
                unknown = token == UNKNOWN
                ends = (np.searchsorted(w.row, np.arange(b - a + 1)) * 2).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(token.astype(np.uint16).tobytes())])
                ids = pa.compute.if_else(x.column("text").slice(a, b - a).is_valid(), ids, pa.scalar(None, pa.binary()))
                spelling = np.bincount(w.row[unknown], weights=spelled(buf, w, unknown, c), minlength=b - a).astype(np.float64)
                yield pa.RecordBatch.from_arrays([x.column("doc_id").slice(a, b - a), x.column("key").slice(a, b - a), ids, pa.array(np.bincount(w.row[unknown], minlength=b - a)), pa.array(spelling)], ["doc_id", "key", "ids", "n_unknown", "spelled"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"), "text")
    return mapped(slim, take, "doc_id long, key long, ids binary, n_unknown long, spelled double")


def _flat(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All token ids of a column of ``token_table``, and how many each row has (a null none)."""
    ids = pa.compute.fill_null(ids, b"")
    ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
    data = ids.buffers()[2]
    return (np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)).view(np.uint16), np.diff(ends) // 2


def stretch_table(coded: DataFrame) -> DataFrame:
    """(id, place, turn, ids, n): the tokens of every text of ``token_table`` and its end, in stretches of STRETCH of which n are used; turn numbers those of a partition."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for x in batches:
            ids, (token, many) = x.column("key").to_numpy(), _flat(x.column("ids"))
            token = np.insert(token, np.cumsum(many), END)
            many = many + 1
            pieces = -(-many // STRETCH)
            row = np.repeat(np.arange(len(many)), pieces)
            place = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH
            first, size = (np.cumsum(many) - many)[row] + place, np.minimum(STRETCH, many[row] - place)
            for lo in range(0, len(row), 4096):
                to = slice(lo, lo + 4096)
                at = first[to, None] + np.minimum(np.arange(STRETCH), size[to, None] - 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row[to]]), pa.array(place[to]), pa.array(np.arange(turn, turn + len(at))), K.binary_rows(token[at]), pa.array(size[to].astype(np.int32))], ["id", "place", "turn", "ids", "n"])
                turn += len(at)

    return mapped(coded.filter("ids IS NOT NULL").select("key", "ids"), take, "id long, place long, turn long, ids binary, n int")


def train(coded: DataFrame, corpus: Corpus) -> Model:
    """The averaged model of a stored ``token_table``. Weights travel once a trainer and turn and are summed before they reach the driver."""
    spark = coded.sparkSession
    model = initial()
    # Biases start at the words' and classes' frequencies.
    group = corpus.unigram.reshape(-1, CLASS)
    in_class = np.log(np.exp(group).sum(axis=1, keepdims=True))
    model.class_bias[:], model.word_bias[:] = in_class[:, 0], group - in_class
    stretches = stored(stretch_table(coded), "stretches")
    n = stretches.count()
    if not n:
        return model
    trainers = max(1, round(n / (SHARE * TURNS)))
    fan = math.isqrt(trainers) + 1
    # The number within the partition deals repeated stretches, of which there may be any number, to all trainers.
    dealt = stretches.withColumn("deal", F.pmod(F.xxhash64("id", "place", "turn", F.lit(SEED)), F.lit(trainers * TURNS)))
    for turn in range(TURNS):
        shared = spark.sparkContext.broadcast(model)

        def work(table: pa.Table) -> pa.Table:
            table = table.sort_by([("id", "ascending"), ("place", "ascending"), ("turn", "ascending")])
            rows = K.from_binary_rows(table.column("ids").combine_chunks(), np.uint16, STRETCH)
            made = train_on(shared.value, rows, table.column("n").to_numpy(), SEED + turn)
            some = table.column("deal")[0].as_py() % fan
            flat = np.concatenate([*[w.ravel() for w in made], [1.0]]).astype(np.float32) * np.float32(len(rows))
            return pa.table({"k": pa.array([0]), "part": pa.array([some]), "w": pa.array([flat.tobytes()], pa.binary())})

        made = dealt.filter(F.col("deal") % TURNS == turn).groupBy("deal").applyInArrow(work, "k long, part long, w binary")
        if total := summed(made, np.float32, np.float64):
            flat = (total[0][:-1] / total[0][-1]).astype(np.float32)
            model = _shaped(flat, model)
        shared.unpersist()
    return model


def lanes_of(sizes: np.ndarray) -> list[np.ndarray]:
    """Rows in lanes of about equal sums, the longest lane first: each row goes to the lane that is shortest so far."""
    order = np.argsort(-sizes, kind="stable")
    lanes: list[list[int]] = [[] for _ in range(min(LANES, len(sizes)))]
    heap = [(0, k) for k in range(len(lanes))]
    for row in order.tolist():
        total, k = heap[0]
        lanes[k].append(row)
        heapq.heapreplace(heap, (total + int(sizes[row]), k))
    for total, k in sorted(heap):
        lanes[k].sort()
    return [np.array(lanes[k]) for _, k in sorted(heap, key=lambda x: (-x[0], x[1]))]


def score_block(m: Model, token: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Log-likelihood of each row's tokens (``many`` of them, one row after the other) and of its end of text.

    Rows are read in lanes, one after the other, so that every step works on many rows whatever their lengths. A row
    starts from a state of zeros, and its first input is the end of the row before, as it is for the lane's first.
    """
    out = np.zeros(len(many))
    if not len(many):
        return out
    size, first = many + 1, np.cumsum(many) - many
    lanes = lanes_of(size)
    length = np.array([size[rows].sum() for rows in lanes])
    target, owner = np.full((int(length[0]), len(lanes)), END, np.int64), np.zeros((int(length[0]), len(lanes)), np.int64)
    begins: dict[int, list[int]] = defaultdict(list)
    for k, rows in enumerate(lanes):
        at = 0
        for row in rows.tolist():
            target[at : at + many[row], k] = token[first[row] : first[row] + many[row]]
            owner[at : at + size[row], k] = row
            begins[at].append(k)
            at += int(size[row])
    emb, rec, weight = by_gate(m.emb + m.bias), by_gate(m.rec), joined(m)
    live = np.searchsorted(-length, -np.arange(int(length[0])), "left")
    h, last = np.zeros((len(lanes), m.rec.shape[0]), m.rec.dtype), np.full(len(lanes), END, np.int64)
    held: list[np.ndarray] = []
    waiting = since = 0
    with np.errstate(over="ignore"):
        for t, k in enumerate(live.tolist()):
            if t in begins:
                h[begins[t]] = 0
            h = step(rec, h[:k], np.take(emb, last[:k], axis=1))[0]
            last = target[t]
            held.append(h)
            waiting += k
            if waiting >= _OUTPUT_ROWS or t + 1 == len(live):
                on = np.arange(len(lanes)) < live[since : t + 1, None]
                np.add.at(out, owner[since : t + 1][on], log_probabilities(m, np.concatenate(held), target[since : t + 1][on], weight))
                held, waiting, since = [], 0, t + 1
    return out


def likelihoods(docs: DataFrame, corpus: Corpus | None = None, model: Model | None = None) -> DataFrame:
    """doc_id, n_tokens, n_unknown, log_likelihood, perplexity for every row of ``docs``, over its whole text.

    n_tokens counts the words and the end of text, perplexity is exp(-log_likelihood / n_tokens). An empty text (or one
    without words) has one token, its end; a null text has none, and null log_likelihood and perplexity. Rows that
    repeat a doc_id are scored each by its text, rows without one as well. An empty table gives an empty one. Other
    columns, whatever their names, aren't read.
    """
    corpus = corpus or counts(docs)
    coded = stored(token_table(docs, corpus), "tokens")
    shared = docs.sparkSession.sparkContext.broadcast(model or train(coded, corpus))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            token, many = _flat(x.column("ids"))
            ends = np.concatenate([[0], np.cumsum(many)])
            parts = [score_block(shared.value, token[ends[a] : ends[b]].astype(np.int64), many[a:b]) for a, b in K.row_blocks(many, _SCORED_TOKENS, x.num_rows)]
            if parts:
                null = x.column("ids").is_null().to_numpy(zero_copy_only=False)
                total, n = np.concatenate(parts) + x.column("spelled").to_numpy(), np.where(null, 0, many + 1)
                yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(n), x.column("n_unknown"), pa.array(np.round(total, 4), mask=null), pa.array(np.exp(np.minimum(700, -total / np.maximum(1, n))), mask=null)], ["doc_id", "n_tokens", "n_unknown", "log_likelihood", "perplexity"])

    return mapped(coded.select("doc_id", "ids", "n_unknown", "spelled"), score, "doc_id long, n_tokens long, n_unknown long, log_likelihood double, perplexity double")
