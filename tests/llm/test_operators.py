"""Each operator against a brute-force version on small tables, and on awkward ones."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quarrymap.llm import bpe, curriculum, fingerprints, gru_lm, ivfpq, kernels, langid, licenses, line_dedup, lsh, minhash_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, key string"
LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(30000))


def docs(spark, texts, **columns):
    """texts: [(doc_id, text)]; three columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en" if t else None, ["a", "b", None][k % 3], len(t) if t else None, "x", "y", "z") for k, (i, t) in enumerate(texts)], DOCS)


#: Nulls in columns, empty and very long texts, repeated rows and ties.
ODD = [(1, "one two three four five"), (1, "one two three four five"), (None, "one two three four five"), (None, None), (3, None), (4, ""), (5, " \n\n "), (6, LONG), (7, LONG + "\nmore"), (8, "¿qué? été ñ"), (9, "x")]


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    made = [" ".join(rng.choice(words) for _ in range(rng.randrange(30, 120))) for _ in range(60)]
    for k in range(20):  # near copies
        w = made[k].split()
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = "changed"
        made.append(" ".join(w))
    made += [made[0]] * 3
    return list(enumerate(made))


def shingle_set(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_kernels_words_and_shingles():
    texts = ["", "a", "Hello wor-ld  ÉÉ x", "one two three four", None, "x y", "  ..  ", "a\n", "b" * 100]
    buf, offsets = kernels.text_buffer(pa.array(texts))
    w = kernels.words(buf, offsets)
    got = [(int(r), bytes(buf[s:e]).decode()) for r, s, e in zip(w.row, w.start, w.end)]
    assert got == [(i, x) for i, t in enumerate(texts) for x in re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())]
    row, _ = kernels.shingles(w, len(texts), 3)
    assert Counter(row.tolist()) == {1: 1, 2: 3, 3: 2, 5: 1, 7: 1, 8: 1}
    assert list(kernels.text_blocks(pa.array([], pa.string()))) == []


def test_near_dedup_against_brute_force(spark, prose):
    got = {r["doc_id"]: r["group_id"] for r in minhash_dedup.near_duplicates(docs(spark, prose)).collect()}
    sets = {i: shingle_set(t) for i, t in prose}
    for a in sets:
        for b in sets:
            if a < b:
                j = jaccard(sets[a], sets[b])
                if j >= 0.65:
                    assert got[a] == got[b], (a, b, j)
                if j <= 0.2:
                    assert got[a] != got[b], (a, b, j)
    kept = minhash_dedup.keep_one_of_each(docs(spark, prose))
    assert kept.columns == docs(spark, prose).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


def test_densified_bins_depend_on_the_set_alone():
    code = kernels.mix64(np.arange(5, dtype=np.uint64))
    a = minhash_dedup.signatures(np.zeros(5, np.int64), code, 1)
    b = minhash_dedup.signatures(np.zeros(10, np.int64), np.concatenate([code[::-1], code]), 1)
    assert (a == b).all() and (a != minhash_dedup._EMPTY).all()


def test_near_dedup_odd(spark):
    rows = minhash_dedup.near_duplicates(docs(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["is_duplicate"]) for r in rows if r["doc_id"] in (1, 6, 7)) == [(False, 1, False), (False, 1, True), (False, 6, False), (False, 7, True)]
    assert {r["doc_id"] for r in rows if r["n_links"]} == {6, 7} and {r["n_links"] for r in rows} == {0, 1}
    assert not any(r["is_duplicate"] for r in rows if r["doc_id"] not in (1, 7))
    assert minhash_dedup.keep_one_of_each(docs(spark, ODD)).count() == len(ODD) - 2
    assert minhash_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_fingerprints_against_brute_force(spark, prose):
    got = {(r["doc_id_a"], r["doc_id_b"]): r["jaccard"] for r in fingerprints.matching_pairs(docs(spark, prose)).collect()}
    sets = {i: shingle_set(t) for i, t in prose}
    first = {}
    for i, t in prose:
        first.setdefault(t, i)
    copies = {(first[t], i) for i, t in prose if first[t] != i}
    true = {(a, b): jaccard(sets[a], sets[b]) for a in first.values() for b in first.values() if a < b and jaccard(sets[a], sets[b]) >= 0.5}
    assert copies <= set(got) and set(got) <= set(true) | copies
    assert len(set(got) & set(true)) >= 0.95 * len(true)
    assert all(abs(got[p] - true[p]) < 1e-9 for p in set(got) & set(true))


def brute_classes(table):
    """doc_id: (class, copies, links, nearest, its Jaccard), over all documents."""
    sets = {i: frozenset(shingle_set(t)) for i, t in table}
    first, n = {}, Counter(sets.values())
    for i in sorted(sets):
        first.setdefault(sets[i] or i, i)
    out = {}
    for i, x in sets.items():
        near = [(jaccard(x, y), -j) for y, j in first.items() if y != x and isinstance(y, frozenset) and jaccard(x, y) >= 0.5]
        out[i] = (first[x] if x else i, n[x] if x else 1, len(near), -max(near)[1] if near else None, pytest.approx(max(near)[0]) if near else None)
    return out


@pytest.mark.parametrize("tile", [256, 2])
def test_fingerprints_by_document(spark, prose, monkeypatch, tile):
    monkeypatch.setattr(fingerprints, "TILE", tile)
    table = [*prose, *[(200 + k, prose[0][1]) for k in range(4)], *[(300 + k, prose[61][1]) for k in range(3)], (400, ""), (401, None)]
    rows = fingerprints.fingerprints(docs(spark, [*table, table[0], (None, table[0][1])])).collect()
    got, want = {r["doc_id"]: tuple(r)[1:] for r in rows}, brute_classes(table)
    assert len(rows) == len(table) and set(got) == set(want)
    assert all(got[i][:2] == want[i][:2] for i in want)
    assert sum(got[i][2:] == want[i][2:] for i in want) >= 0.95 * len(want) and all(got[i][2] <= want[i][2] for i in want)


def test_fingerprints_odd_and_tiles(spark, monkeypatch):
    got = fingerprints.matching_pairs(docs(spark, ODD)).collect()
    assert [(r["doc_id_a"], r["doc_id_b"]) for r in got] == [(6, 7)]
    assert fingerprints.matching_pairs(docs(spark, [])).count() == 0 and fingerprints.fingerprints(docs(spark, [])).count() == 0
    rows = {r["doc_id"]: r for r in fingerprints.fingerprints(docs(spark, ODD)).collect()}
    assert sorted(rows) == [1, 3, 4, 5, 6, 7, 8, 9] and [i for i in rows if rows[i]["n_links"]] == [6, 7]
    monkeypatch.setattr(fingerprints, "TILE", 4)
    base = [f"t{i}" for i in range(200)]
    many = [(k, " ".join([*base, f"own{k}"])) for k in range(11)]
    assert fingerprints.matching_pairs(docs(spark, many)).count() == 55


@pytest.mark.parametrize("tile", [2048, 3])
def test_edges_connect_all_that_is_similar_in_a_bucket(spark, monkeypatch, tile):
    monkeypatch.setattr(lsh, "TILE", tile)
    rng = np.random.default_rng(6)
    sig = rng.integers(0, 256, (10, 64)).astype(np.uint8)
    sig = np.concatenate([sig, sig])  # ten mutually unlike pairs (k, k + 10) in one bucket
    chain = sig[:1].copy()
    chain[:, :32] = rng.integers(0, 256, 32)  # 20 is like 0 (half), 21 is like 20 but not like 0
    last = chain.copy()
    last[:, 32:60] = rng.integers(0, 256, 28)
    sig = np.concatenate([sig, chain, last])
    again = [(30 + i, [7, 8], bytearray(sig[i].tobytes()), i) for i in (3, 21)]  # equal signatures
    table = spark.createDataFrame([*[(i, [7, 8], bytearray(s.tobytes()), i % 10 if i < 20 else i) for i, s in enumerate(sig)], *again], "id long, bands array<long>, sig binary, same long")
    roots = {r["id"]: r["root"] for r in lsh.components(lsh.similar_edges(table, 64, 0.45)).collect()}
    assert roots == {**{k: k % 10 for k in range(20)}, 20: 0, 21: 0, 33: 3, 51: 0}


def test_toxicity_finds_what_marks_the_positives(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    texts, labels, toxic = [], [], set()
    for i in range(800):
        w = [rng.choice(words) for _ in range(60)]
        if i % 8 == 0:
            toxic.add(i)
            for bad in rng.sample(["zonker", "blatwit", "grumpox"], 2) * 2:
                w[rng.randrange(60)] = bad
        texts.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, 1, int(i in toxic)))
    table = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["is_toxic"] for r in toxicity.classify(docs(spark, texts), table).collect()}
    unlabelled = [i for i in got if i % 2]
    assert sum(got[i] for i in toxic) >= 0.9 * len(toxic)
    assert sum(got[i] for i in unlabelled if i not in toxic) <= 0.02 * len(unlabelled)
    kept = toxicity.keep_harmless(docs(spark, texts), table)
    assert kept.count() == sum(not t for t in got.values()) and kept.columns == docs(spark, texts).columns


def test_toxicity_odd(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not any(r["is_toxic"] for r in toxicity.classify(docs(spark, ODD), none).collect())
    assert toxicity.keep_harmless(docs(spark, ODD), none).count() == len(ODD)
    assert toxicity.classify(docs(spark, []), none).count() == 0


def brute_nnpu(texts, positives, prior):
    """Scores by dense features, counts and gradients, without hashing blocks, chunks, partitions or trainers."""
    def codes(text):
        buf, offsets = kernels.text_buffer(pa.array([text]))
        raw = bytes(buf)
        found = Counter(int(b) for b in (kernels.mix64(kernels.words(buf, offsets).hash ^ np.uint64(0x77)) >> np.uint64(44)))
        for n in (5, 7):
            for i in range(len(raw) - n + 1):
                found[(int.from_bytes(raw[i : i + n], "little") * int(toxicity._GRAM_CODE[n]) % 2**64) >> 44] += 1
        words = len(kernels.words(buf, offsets).row)
        return {level * toxicity.BUCKETS + b for level, (least, spread) in enumerate(toxicity.LEVELS) for b, k in found.items() if k >= least and (not spread or k * spread >= words)}

    has = {i: codes(t) for i, t in texts}
    p, u = (Counter(c for i in has if (i in positives) == side for c in has[i]) for side in (True, False))
    names = sorted(p)
    n_p, n_u = len(positives), len(texts) - len(positives)
    chosen = toxicity.strong(np.array([p[c] for c in names]), np.array([u[c] for c in names]), n_p, n_u, prior)
    features = [names[k] for k in chosen]
    x = np.array([[c in has[i] for c in features] for i, _ in texts], float)
    mine = np.array([i in positives for i, _ in texts])
    w, b, m, v = np.zeros(len(features)), np.log(prior / (1 - prior)), np.zeros(len(features) + 1), np.zeros(len(features) + 1)
    for step in range(1, toxicity.STEPS + 1):
        s = 1 / (1 + np.exp(-(x @ w + b)))
        slope = s * (1 - s)
        sign = 1 if s.mean() >= prior * s[mine].mean() else -1
        g = sign * slope / len(texts)
        g[mine] += (-2 if sign == 1 else 1) * prior * slope[mine] / n_p
        grad = np.append(x.T @ g + toxicity.DECAY * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = toxicity.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return {i: s for (i, _), s in zip(texts, 1 / (1 + np.exp(-(x @ w + b))))}, len(features)


def test_toxicity_against_brute_force(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    texts = [(i, " ".join([rng.choice(words) for _ in range(25)] + (["zonker", "blatwit"] if i % 6 == 0 else []))) for i in range(240)]
    positives = {i for i in range(0, 240, 12)}
    table = spark.createDataFrame([(i, 1, int(i in positives)) for i in range(0, 240, 4)], "doc_id long, quality int, toxic int")
    want, features = brute_nnpu(texts, positives, len(positives) / 60)
    got = {r["doc_id"]: r["score"] for r in toxicity.classify(docs(spark, texts), table).collect()}
    assert features > 5 and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)
    again = {r["doc_id"]: r["score"] for r in toxicity.classify(docs(spark, texts), table).collect()}
    assert again == got


def test_toxicity_of_odd_rows_by_a_fitted_model(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    texts = [(i, " ".join([rng.choice(words) for _ in range(40)] + (["zonker", "blatwit", "grumpox"] if i % 5 == 0 else []))) for i in range(400)]
    table = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    bad = "zonker blatwit grumpox"
    odd = [(1000, None), (1001, ""), (1002, " \n "), (1003, LONG), (1004, LONG + " " + " ".join([bad] * 100)), (None, bad), (5, "another text of a doc_id"), (1005, bad), (1005, bad)]
    rows = toxicity.classify(docs(spark, [*texts, *odd]), table).collect()
    assert len(rows) == len(texts) + len(odd)
    got = {r["doc_id"]: r["is_toxic"] for r in rows if r["doc_id"] is None or r["doc_id"] >= 1000}
    assert got == {1000: False, 1001: False, 1002: False, 1003: False, 1004: True, 1005: True, None: True}
    assert toxicity.keep_harmless(docs(spark, [*texts, *odd]), table).count() == sum(not r["is_toxic"] for r in rows)


def test_long_rows_have_the_features_of_short_blocks(monkeypatch):
    text = LONG[:60000]
    one = toxicity.Block(0, 1, *(b := kernels.text_buffer(pa.array([text]))), kernels.words(*b))
    two = toxicity.Block(0, 2, *(b := kernels.text_buffer(pa.array([text, "x"]))), kernels.words(*b))
    used = np.ones(toxicity.BUCKETS, bool)
    row, code = two.features(used)
    assert (one.features(used)[1] == code[row == 0]).all()
    monkeypatch.setattr(toxicity, "_BLOCK", 1000)
    assert (one.features(used)[1] == code[row == 0]).all()


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    buf, offsets = kernels.text_buffer(pa.array(["ab cdefghijklmnopqrstuvwxyz ab", "", "abc ab"]))
    want = kernels.words(buf, offsets).hash
    monkeypatch.setattr(kernels, "BLOCK_BYTES", 5)
    monkeypatch.setattr(kernels, "_powers", {})
    assert (kernels.words(buf, offsets).hash == want).all() and want[0] == want[2] == want[4]


def test_negative_risk_turns_the_gradient():
    one = np.ones(1)
    up = toxicity.risk_gradient(np.zeros(1), one, np.zeros(1), one, 0.1)
    assert up[0][0] < 0 < up[1][0]
    back = toxicity.risk_gradient(np.array([5.0]), one, np.array([-5.0]), one, 0.9)
    assert back[0][0] > 0 > back[1][0]


def brute_lm(model, corpus, text):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", text.lower().encode())
    buf, offsets = kernels.text_buffer(pa.array([text]))
    ids = gru_lm.tokens(buf, kernels.words(buf, offsets), corpus).tolist()
    h, last, total = np.zeros(model.rec.shape[0]), gru_lm.END, 0.0
    size = len(h)
    m = gru_lm.Model(*(w.astype(np.float64) for w in model))
    for k, t in enumerate([*ids, gru_lm.END]):
        x, u = m.emb[last] + m.bias, h @ m.rec
        z, r = (1 / (1 + np.exp(-(x[i * size : i * size + size] + u[i * size : i * size + size]))) for i in (0, 1))
        n = np.tanh(x[2 * size :] + r * u[2 * size :])
        h = (1 - z) * n + z * h
        c = h @ m.to_class + m.class_bias
        w = h @ m.to_word[t // gru_lm.CLASS] + m.word_bias[t // gru_lm.CLASS]
        total += c[t // gru_lm.CLASS] - np.log(np.exp(c).sum()) + w[t % gru_lm.CLASS] - np.log(np.exp(w).sum())
        if k < len(ids) and t == gru_lm.UNKNOWN:
            s = [0, *words[k], 0]
            total += sum(corpus.spelling[a, b] for a, b in zip(s, s[1:]))
        last = t
    return total


def test_lm_scores_whole_documents(spark, prose):
    table = docs(spark, [*prose, *[(100 + (i or 0), t) for i, t in ODD[3:]]])
    corpus = gru_lm.counts(table)
    model = gru_lm.train(gru_lm.token_table(table, corpus), corpus)
    got = {r["doc_id"]: r for r in gru_lm.likelihoods(table, corpus, model).collect()}
    for i, t in [*prose[:5], (106, LONG), (104, ""), (108, "¿qué? été ñ")]:
        assert got[i]["log_likelihood"] == pytest.approx(brute_lm(model, corpus, t), rel=1e-4, abs=1e-2)
    assert got[103]["n_tokens"] == 0 and got[103]["log_likelihood"] is None and got[104]["n_tokens"] == 1
    assert gru_lm.likelihoods(docs(spark, [])).count() == 0


def test_lm_gradients_are_right():
    rng = np.random.default_rng(0)
    m = gru_lm.Model(*(rng.standard_normal(w.shape) * 0.3 for w in gru_lm.initial(128, 4)))
    ids, live, h0 = rng.integers(0, 128, (5, 3)), np.array([3, 3, 3, 2, 2]), rng.standard_normal((3, 4)) * 0.1
    before = np.vstack([np.ones((1, 3), np.int64), ids[:-1]])
    grads, _, _ = gru_lm.gradients(m, h0, before, ids, live)
    for k, w in enumerate(m):
        for at in {int(np.abs(grads[k]).argmax()), 0}:
            losses = []
            for d in (1e-5, -1e-5):
                moved = w.copy()
                moved.flat[at] += d
                losses.append(gru_lm.gradients(m._replace(**{m._fields[k]: moved}), h0, before, ids, live)[2])
            assert grads[k].flat[at] == pytest.approx((losses[0] - losses[1]) / 2e-5 / live.sum(), rel=1e-3, abs=1e-6)


def test_lm_counts_byte_pairs():
    for texts in (["abc ab", "ab", "", "ab,b", "é"], ["", " ", "x"], [" .", ""], ["a" * 9, "b"]):
        buf, offsets = kernels.text_buffer(pa.array(texts))
        want = Counter()
        for t in texts:
            for word in re.findall(rb"[0-9a-z\x80-\xff]+", t.encode()):
                want.update(zip([0, *word], [*word, 0]))
        got = gru_lm._pair_counts(buf, kernels.words(buf, offsets))
        assert {(int(k) >> 8, int(k) & 255): int(got[k]) for k in np.flatnonzero(got)} == want


def test_lm_sums_by_token():
    rng = np.random.default_rng(1)
    tokens, rows = rng.choice([1, 5, 7, 8, 30], 300, p=[0.8, 0.05, 0.05, 0.05, 0.05]), rng.standard_normal((300, 6))
    want = np.zeros((40, 6))
    np.add.at(want, tokens, rows)
    assert gru_lm._by_token(tokens, rows, 40) == pytest.approx(want)


def test_lm_blocks_and_rooms_change_no_gradient(monkeypatch):
    rng = np.random.default_rng(4)
    m = gru_lm.Model(*(rng.standard_normal(w.shape) * 0.3 for w in gru_lm.initial(192, 4)))
    ids, before, h0, room = rng.integers(0, 192, (6, 9)), rng.integers(0, 192, (6, 9)), rng.standard_normal((9, 4)) * 0.3, gru_lm.Room()
    for live in ([9] * 6, [9, 7, 7, 4, 1, 1], [5, 5, 5, 2, 2, 1]):  # what one window left in the room isn't in the next
        some, live = live[0], np.array(live)
        monkeypatch.setattr(gru_lm, "_BLOCK", 1024)
        want = gru_lm.gradients(m, h0[:some], before[:, :some], ids[:, :some], live)
        monkeypatch.setattr(gru_lm, "_BLOCK", 3)  # classes go on from block to block
        into = gru_lm.Model(*(np.full_like(w, np.nan) for w in m))
        got = gru_lm.gradients(m, h0[:some], before[:, :some], ids[:, :some], live, into=into, room=room)
        assert all(g == pytest.approx(w) for g, w in zip(into, want[0]))
        assert got[1] == pytest.approx(want[1]) and got[2] == pytest.approx(want[2])
    h, target = rng.standard_normal((50, 4)), rng.integers(0, 192, 50)
    c, w = h @ m.to_class + m.class_bias, np.einsum("ij,ijk->ik", h, m.to_word[target // gru_lm.CLASS]) + m.word_bias[target // gru_lm.CLASS]
    at = np.arange(50)
    want = c[at, target // gru_lm.CLASS] - np.log(np.exp(c).sum(axis=1)) + w[at, target % gru_lm.CLASS] - np.log(np.exp(w).sum(axis=1))
    assert gru_lm.log_probabilities(m, h, target) == pytest.approx(want)
    assert gru_lm.log_probabilities(m._replace(class_bias=m.class_bias + 1000), h, target) == pytest.approx(want)  # large logits


def test_lm_finds_words_whose_hashes_begin_alike():
    known = np.array([3, 5, 6, 1 << 50, (1 << 50) + 1, (1 << 64) - 1], np.uint64)
    asked = np.array([6, 4, 3, 0, 5, (1 << 50) + 1, 1 << 50, 1 << 51, (1 << 64) - 1, (1 << 64) - 2], np.uint64)
    none = np.zeros(0, np.int64)
    corpus = gru_lm.Corpus(known, np.arange(2, 8, dtype=np.int32), None, None)
    got = gru_lm.tokens(None, kernels.Words(none, none, none, asked), corpus)
    assert got.tolist() == [4, 0, 2, 0, 3, 6, 5, 0, 7, 0]


def test_lm_lanes_hold_every_row_once():
    for sizes in ([5, 1, 1, 9, 2], [3], [1] * 700):
        lanes = gru_lm.lanes_of(np.array(sizes))
        total = [sum(sizes[i] for i in lane) for lane in lanes]
        assert sorted(np.concatenate(lanes).tolist()) == list(range(len(sizes))) and total == sorted(total, reverse=True)


def test_lm_odd(spark):
    table = docs(spark, [*ODD, *[(20 + k, "one two three four five") for k in range(40)]])
    rows = gru_lm.likelihoods(table).collect()
    assert len(rows) == len(ODD) + 40
    same = {(r["n_tokens"], r["log_likelihood"]) for r in rows if r["doc_id"] == 1 or (r["doc_id"] or 0) >= 20}
    assert len(same) == 1 and same <= {(r["n_tokens"], r["log_likelihood"]) for r in rows if r["doc_id"] is None}
    assert {r["n_tokens"] for r in rows if r["doc_id"] == 3} == {0} and {r["n_tokens"] for r in rows if r["doc_id"] in (4, 5)} == {1}


def test_lm_learns_order(spark):
    table = docs(spark, [(i, " ".join(["red green blue white black"] * 8)) for i in range(300)])
    corpus = gru_lm.counts(table)
    got = gru_lm.likelihoods(docs(spark, [(1, "red green blue white black red green blue"), (2, "blue red black green white blue green red")]), corpus, gru_lm.train(gru_lm.token_table(table, corpus), corpus))
    score = {r["doc_id"]: r["log_likelihood"] for r in got.collect()}
    assert score[1] > score[2] + 3


def test_lm_trains_on_every_word(spark, prose):
    table = [*prose, (500, LONG), (501, ""), (502, None), (503, " ".join(["word"] * (gru_lm.STRETCH - 1))), (504, " ".join(["word"] * gru_lm.STRETCH))]
    corpus = gru_lm.counts(docs(spark, table))
    got = defaultdict(list)
    for r in sorted(gru_lm.stretch_table(gru_lm.token_table(docs(spark, table), corpus)).collect(), key=lambda r: (r["id"], r["place"])):
        assert r["place"] == len(got[r["id"]])
        got[r["id"]] += np.frombuffer(r["ids"], np.uint16)[: r["n"]].tolist()
    assert 502 not in got
    for i, t in table:
        buf, offsets = kernels.text_buffer(pa.array([t or ""]))
        assert t is None or got[i] == [*gru_lm.tokens(buf, kernels.words(buf, offsets), corpus).tolist(), gru_lm.END]
    assert gru_lm.STRETCH >= 4 * gru_lm.WINDOW, "the state crosses several windows"


def brute_neighbours(x, ids, k=10):
    d = ((x[:, None].astype(np.float64) - x) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    return {int(ids[i]): [(int(ids[j]), d[i, j] ** 0.5) for j in np.lexsort((ids, np.float32(d[i])))[:k]] for i in range(len(ids))}


def found_neighbours(table, every):
    got = defaultdict(list)
    for r in sorted(ivfpq.neighbours(table, every=every).collect(), key=lambda r: (r["vec_id"], r["rank"])):
        got[r["vec_id"]].append((r["neighbor_id"], r["distance"]))
        assert r["rank"] == len(got[r["vec_id"]])
    return got


@pytest.mark.parametrize("cell", [4096, 20])
def test_neighbours_recall(spark, monkeypatch, cell):
    monkeypatch.setattr(ivfpq, "CELL", cell)  # 20: lists of several cells
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((12, 24))[rng.integers(0, 12, 1500)] + 0.5 * rng.standard_normal((1500, 24))).astype(np.float32)
    got = found_neighbours(spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<float>, list string"), 5)
    true = brute_neighbours(x, np.arange(1500))
    assert sorted(got) == list(range(0, 1500, 5)) and all(len(g) == 10 for g in got.values())
    assert np.mean([len({j for j, _ in got[i]} & {j for j, _ in true[i]}) / 10 for i in got]) >= 0.9
    d = np.sqrt(((x[:, None].astype(np.float64) - x) ** 2).sum(axis=2))
    assert all(abs(far - d[i, j]) < 1e-3 for i in got for j, far in got[i])


def test_neighbours_in_dense_groups(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 64))
    x[:100] = x[0] + 1e-3 * rng.standard_normal((100, 64))  # near copies
    x[100:700] = x[100] + 1e-3 * rng.standard_normal((600, 64))
    x[700:800] = x[700]  # copies
    x = x.astype(np.float32)
    got = found_neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), 1)
    true = brute_neighbours(x, np.arange(3000))
    assert np.mean([len({j for j, _ in got[i]} & {j for j, _ in true[i]}) / 10 for i in range(700)]) >= 0.99
    assert np.mean([len({j for j, _ in got[i]} & {j for j, _ in true[i]}) / 10 for i in range(3000)]) >= 0.9
    for i in range(700, 800):
        assert [j for j, _ in got[i]] == [j for j in range(700, 800) if j != i][:10]


def test_neighbours_odd(spark):
    schema = "vec_id long, embedding array<float>, label int, id int, list int"
    table = spark.createDataFrame([(i, v, 0, 0, 0) for i, v in [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, -0.0]), (4, None), (None, [1.0, 1.0]), (5, [float("nan"), 1.0]), (6, [1.0]), (7, [None, 1.0]), (8, [])]], schema)
    got = sorted((r["vec_id"], r["rank"], r["neighbor_id"]) for r in ivfpq.neighbours(table, every=1).collect())
    assert got == [(1, 1, 2), (1, 2, 3), (2, 1, 3), (2, 2, 1), (3, 1, 2), (3, 2, 1)]
    assert [r["vec_id"] for r in ivfpq.neighbours(table, every=2).collect()] == [2, 2]
    assert ivfpq.neighbours(spark.createDataFrame([], schema)).count() == 0
    assert ivfpq.neighbours(table.limit(1), every=1).count() == 0


def test_curriculum_meets_its_weights(spark):
    rng = random.Random(3)
    table = spark.createDataFrame([(i, "x" * rng.randrange(40, 400), None, rng.choice("aaab"), 0, "", "", "") for i in range(3000)], DOCS)
    weights = spark.createDataFrame([(s, t, w) for s, a, b in (("a", 0.9, 0.2), ("b", 0.1, 0.8)) for t, w in ((0.0, a), (1.0, b))], "source string, t double, weight double")
    rows = curriculum.positions(table, weights).collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    assert {r["doc_id"] for r in rows} == set(range(3000)), "no document is lost"
    for lo in (0.0, 0.25, 0.5, 0.75):
        part = [r for r in rows if lo <= r["position"] < lo + 0.25]
        share = sum(r["n_tokens"] for r in part if r["source"] == "b") / sum(r["n_tokens"] for r in part)
        assert share == pytest.approx(0.1 + 0.7 * (lo + 0.125), abs=0.03)
    assert all(0 <= r["position"] <= 1 for r in rows)


def test_curriculum_does_not_depend_on_buckets(spark, monkeypatch):
    table = docs(spark, [*ODD, *[(20 + k, "word " * (k % 17)) for k in range(200)]])
    want = curriculum.positions(table).collect()
    monkeypatch.setattr(curriculum, "BUCKET_ROWS", 0.01)
    assert curriculum.positions(table).collect() == want
    monkeypatch.setattr(curriculum, "LEAST_DIGITS", 0)
    monkeypatch.setattr(curriculum, "BUCKET_ROWS", 1 << 20)
    assert curriculum.positions(table).collect() == want


def test_curriculum_odd(spark):
    rows = curriculum.positions(docs(spark, ODD)).collect()
    assert Counter((r["doc_id"], r["copy"]) for r in rows if r["copy"] == 0) == Counter((i, 0) for i, _ in ODD)
    out = curriculum.mixed(docs(spark, ODD))
    assert out.columns == docs(spark, ODD).columns and out.count() == len(rows)
    assert curriculum.positions(docs(spark, [])).count() == 0


def brute_lines(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        kept = []
        for line in (t or "").split("\n"):
            if not line.strip(" \t\r\v\f") or line not in seen:
                kept.append(line)
            seen.add(line)
        out.append((i, None if t is None else "\n".join(kept)))
    return out


@pytest.mark.parametrize("saturated", [False, True])
def test_line_dedup_against_brute_force(spark, monkeypatch, saturated):
    if saturated:  # a filter that lets everything through changes no result
        monkeypatch.setattr(line_dedup, "twice_filter", lambda _: np.full(1 << 16, 255, np.uint8))
    rng = random.Random(4)
    texts = [(i, "\n".join(rng.choice(["", " ", "é", *(f"line {k}" for k in range(60))]) for _ in range(rng.randrange(0, 9)))) for i in range(200)]
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.deduplicate_lines(docs(spark, texts)).collect())
    assert got == sorted(brute_lines(texts))


def test_line_dedup_odd(spark):
    got = [(r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.deduplicate_lines(docs(spark, ODD)).collect()]
    assert sorted(x for x in got if x[0] == 1) == [(1, "", 1), (1, "one two three four five", 0)]
    assert (None, "", 1) in got and (None, None, 0) in got and (4, "", 0) in got and (5, " \n\n ", 0) in got and (7, "more", 1) in got
    kept = line_dedup.keep_first_lines(docs(spark, ODD))
    assert kept.columns == docs(spark, ODD).columns and kept.count() == len(ODD) - 2
    assert {r["doc_id"]: r["n_chars"] for r in kept.collect()}[7] == 4
    assert line_dedup.deduplicate_lines(docs(spark, [])).count() == 0


def test_license_rules(spark):
    mit = "\n".join(["Copyright (c) 2020 Some One", licenses._MIT_GRANT + ":", licenses._MIT_NOTICE + ".", licenses._MIT_AS_IS + "."])
    wrapped = re.sub(r"(.{40,60}) ", r"\1\n", mit.replace("\n", "\n\n"))
    swapped = "\n".join([licenses._MIT_NOTICE + ".", licenses._MIT_GRANT + ":", licenses._MIT_AS_IS + "."])
    texts = [(1, "x\nReleased*** under&&& the MIT License."), (2, mit), (3, wrapped), (4, swapped), (5, "Licensed under the Apache License, Version 2.0. Licensed under the Apache License, Version 2.0."), (6, "a licence"), (7, "\n".join(s + "." for s in (licenses._BSD_GRANT, licenses._BSD_SOURCE, licenses._BSD_BINARY, licenses._BSD_NAMES)))]
    got = sorted((r["doc_id"], r["license"], r["n_matches"]) for r in licenses.scan(docs(spark, texts)).collect())
    assert got == [(1, "MIT", 1), (2, "MIT", 1), (3, "MIT", 1), (5, "Apache-2.0", 2), (7, "BSD-2-Clause", 1), (7, "BSD-3-Clause", 1)]
    assert licenses.scan(docs(spark, ODD)).count() == 0 and licenses.scan(docs(spark, [])).count() == 0


def test_licenses_as_published(spark):
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby\ngranted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\""
    free = "This is free and unencumbered software released into the public\n  domain.\n\nAnyone is free to copy"
    clauses = ["Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission."]
    bsd = "Copyright (c) 2020, Some One\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
    end = "\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS"
    gpl = "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.\n\n    This program is distributed"
    lgpl = "    This library is free software; you can redistribute it and/or\n    modify it under the terms of the GNU Lesser General Public\n    License as published by the Free Software Foundation; either\n    version 2.1 of the License, or (at your option) any later version.\n\n    This library"
    texts = [(1, isc), (2, free), (3, bsd + "\n\n".join(f"{k + 1}. {c}" for k, c in enumerate(clauses[:2])) + end), (4, bsd + "\n\n".join(f"{k + 1}. {c}" for k, c in enumerate(clauses)) + end), (5, bsd + "\n".join(f"({'abc'[k]}) {c}" for k, c in enumerate(clauses[:2])) + end), (6, gpl), (7, gpl.replace("General", "Lesser General")), (8, lgpl), (9, bsd + "\n".join(f"  * {c}" for c in clauses[:2]) + end)]
    got = sorted((r["doc_id"], r["license"], r["n_matches"]) for r in licenses.scan(docs(spark, texts)).collect())
    assert got == [(1, "ISC", 1), (2, "Unlicense", 1), (3, "BSD-2-Clause", 1), (4, "BSD-2-Clause", 1), (4, "BSD-3-Clause", 1), (5, "BSD-2-Clause", 1), (6, "GPL-3.0", 1), (7, "LGPL-3.0", 1), (8, "LGPL-2.1", 1), (9, "BSD-2-Clause", 1)]


def test_licenses_by_identifier_and_note(spark):
    texts = ["/* SPDX-License-Identifier: BSD-3-Clause */", "# SPDX-License-Identifier: GPL-2.0-or-later\nint x;", "// SPDX-License-Identifier: LGPL-2.1-only", "// SPDX-License-Identifier: MIT OR Apache-2.0", "This file is released under the MIT License.", "x. This project is licensed under the\nApache License, Version 2.0. y", "            GNU AFFERO GENERAL PUBLIC LICENSE\n              Version 3, 19 November 2007\n\n Copyright", "mit\napache 2.0", licenses._ZLIB + ":", "To the extent possible under law, the author(s) have dedicated all\ncopyright and related and neighboring rights to this software to the public\ndomain worldwide. This software", "a licence " + "word " * 200000 + "\nReleased under the MIT License."]
    rows = [*enumerate(texts), (4, texts[4]), (None, texts[4])]
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["license"], r["n_matches"]) for r in licenses.scan(docs(spark, rows)).collect())
    assert got == [(-1, "MIT", 1), (0, "BSD-3-Clause", 1), (1, "GPL-2.0", 1), (2, "LGPL-2.1", 1), (3, "Apache-2.0", 1), (3, "MIT", 1), (4, "MIT", 1), (4, "MIT", 1), (5, "Apache-2.0", 1), (6, "AGPL-3.0", 1), (8, "Zlib", 1), (9, "CC0-1.0", 1), (10, "MIT", 1)]


def dense_languages(table, idf):
    """(names, centroids of each) by loops over texts and clusters; texts: (lang, text) in the order of training."""
    def vector(text):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", text.lower().encode())
        raw, x = b" " + b" ".join(words) + b" " if words else b"", np.zeros(langid.BUCKETS)
        for i in range(len(raw) - 2):
            code = (raw[i] * 257 + raw[i + 1]) * 257 + raw[i + 2]
            x[int(kernels.mix64(np.array([code], np.uint64))[0]) >> 52] += 1
        return np.log1p(x) * idf / max(1e-12, np.linalg.norm(np.log1p(x) * idf))

    return {lang: np.array([vector(t) for own, t in table if own == lang]) for lang in sorted({lang for lang, _ in table})}, vector


def test_languages_against_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    spelled = {"aa": "abcdeilmno", "bb": "prstuvwxyz", "cc": "éèßøåñçæœü"}
    rows = [(i, lang, " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(5, 40)))) for i, (lang, letters) in enumerate(list(spelled.items()) * 20)]
    table = spark.createDataFrame([(i, t, lang if i % 3 or i < 30 else None) for i, lang, t in rows], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "CENTROIDS", 1)  # then a centroid is the mean of its texts, whatever the seed
    seen, n = langid.document_frequencies(table)
    idf = np.log((1 + n) / (1 + seen)) + 0.1
    own, vector = dense_languages([(lang, t) for i, lang, t in rows if i % 3 or i < 30], idf)
    assert seen.tolist() == sum((np.array([vector(t) for _, _, t in rows]) > 0).astype(int)).tolist()
    centre = {lang: x.sum(axis=0) / np.linalg.norm(x.sum(axis=0)) for lang, x in own.items()}
    for r in langid.identify(table).collect():
        cosines = {lang: float(vector(rows[r["doc_id"]][2]) @ c) for lang, c in centre.items()}
        assert r["predicted"] in (max(cosines, key=cosines.get), langid.REJECTED) and r["cosine"] == pytest.approx(max(cosines.values()), abs=1e-4)


def test_languages_learn_from_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_SAMPLES", 3)
    monkeypatch.setattr(langid, "CENTROIDS", 1)
    rng = random.Random(21)
    # Ids repeat and are missing; one text has a run of bytes more than 255 times.
    rows = [(None if i % 7 == 0 else i % 11, " ".join("".join(rng.choice(letters) for _ in range(3)) for _ in range(rng.randrange(5, 9) * 2 ** (i // 2 % 7))), lang) for i, (lang, letters) in enumerate([("aa", "abcdeilmno"), ("bb", "prstuvwxyz")] * 35)]
    rows += [(90, "xyz " * 700, "bb"), (91, "abc", None), (92, " .. ", "aa"), (93, None, "bb")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen, n = langid.document_frequencies(table)
    idf = np.log((1 + n) / (1 + seen)) + 0.1
    own, vector = dense_languages([(lang, t) for _, t, lang in rows if lang and t and t.strip(" .")], idf)
    centre = {lang: x.sum(axis=0) / np.linalg.norm(x.sum(axis=0)) for lang, x in own.items()}
    want = sorted((i or 0, round(max(float(vector(t or "") @ c) for c in centre.values()), 4)) for i, t, _ in rows)
    got = sorted((r["doc_id"] or 0, r["cosine"]) for r in langid.identify(table).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([c for _, c in got], [c for _, c in want], atol=2e-4)
    least = langid.train(table, langid.bag_table(table)).least
    for k, lang in enumerate(centre):
        size = np.searchsorted(langid.LENGTHS, [4 * len(t.split()) - 1 for _, t, own_lang in rows if own_lang == lang and t and t.strip(" .")])
        each = [langid.SLACK * np.quantile((own[lang] @ centre[lang])[size == c], langid.REJECT_SHARE) for c in range(len(langid.LENGTHS))]
        assert min(each) > 0 and np.allclose(least[k], [min(each[c:]) for c in range(len(each))], atol=1e-5)


def test_language_samples_are_the_smallest_hashes(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(langid, "MOST_SAMPLES", 20)
    # One id has most rows of a language, so a bound by the number of rows lets too few ids pass at first.
    rows = [*[(i, "a") for i in range(500)], *[(7, "b")] * 3000, *[(i, "b") for i in range(8, 40)], (1, "c")]
    table = spark.createDataFrame(rows, "doc_id long, lang string")
    code = {r[0]: r[1] for r in table.select("doc_id", F.xxhash64("doc_id", F.lit(langid.SEED))).distinct().collect()}
    got = defaultdict(list)
    for i, lang in langid.sampled_ids(table).collect():
        got[lang].append(i)
    for lang in "abc":
        ids = sorted({i for i, own in rows if own == lang}, key=lambda i: (code[i], i))
        assert sorted(got[lang]) == sorted(ids[:20])


def test_equal_cosines_give_the_first_name(spark):
    table = spark.createDataFrame([(1, "same words here", "yy"), (2, "same words here", "xx"), (3, "same words here", None)], "doc_id long, text string, lang string")
    assert {r["predicted"] for r in langid.identify(table).collect()} == {"xx"}


def test_languages_of_held_out_texts(spark, medium):
    table = spark.read.parquet(f"{medium}/documents.parquet")
    held = table.selectExpr("doc_id", "text", "CASE WHEN doc_id % 2 = 0 THEN lang END AS lang", "source")
    lang = {r["doc_id"]: r["lang"] for r in table.select("doc_id", "lang").collect()}
    got = {r["doc_id"]: r["predicted"] for r in langid.identify(held).collect()}
    odd = [i for i in got if i % 2]
    assert np.mean([got[i] == lang[i] for i in odd]) >= 0.98
    assert np.mean([got[i] == langid.REJECTED for i in got]) <= 0.01


def test_languages_odd(spark):
    rows = {(r["doc_id"], r["predicted"]) for r in langid.identify(docs(spark, ODD)).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (None, "und"), (1, "en")} <= rows
    assert {r["predicted"] for r in langid.identify(docs(spark, [(1, None), (2, "")])).collect()} == {"und"}
    assert langid.identify(docs(spark, [])).count() == 0


def test_bpe_pieces_are_the_pattern_s():
    import regex

    find, rng = regex.compile(bpe.PATTERN).findall, random.Random(6)
    for _ in range(1500):
        texts = ["".join(rng.choice("abs'tre vlmd  \n\t19²é中!?- \x1ć") for _ in range(rng.randrange(0, 14))) for _ in range(4)]
        buf, offsets = kernels.text_buffer(pa.array(texts), False)
        start, n = bpe.cut(buf, offsets)
        end = np.append(start[1:], len(buf))
        flat = [bytes(buf[a:b]).decode() for a, b in zip(start, end)]
        assert flat == [p for t in texts for p in find(t)] and n.tolist() == [len(find(t)) for t in texts]


def test_bpe_against_the_library(spark, small):
    import tiktoken

    ranks = bpe.read_vocabulary(bpe.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    coded = bpe.encode(table, size=500)
    for r in coded.collect():
        assert r["tokens"] == library.encode_ordinary(texts[r["doc_id"]]) and r["round_trip"]
    assert {r["doc_id"]: r["text"] for r in bpe.decode(coded).collect()} == texts
    rng = random.Random(7)
    for n in (1, 39, 41, 63, 65, 700):
        word = "".join(rng.choice("aeinstré") for _ in range(n))
        assert bpe.merge(word.encode(), ranks) == library.encode_ordinary(word)


def test_bpe_lexicon_is_exact_and_minimal(tmp_path):
    ranks = bpe.read_vocabulary(bpe.VOCABULARY)
    words = [b"walk", b"walked", b"walking", b"talk", b"talked", b"talking", " été".encode(), b"a"]
    lexicon = bpe.compile_lexicon(words, ranks)
    (tmp_path / "l").write_bytes(bpe.packed(lexicon))
    lexicon = bpe.mapped(str(tmp_path / "l"))
    text = b"".join([*words, b"wal", b"walkin", b"b"])
    size = np.array([len(w) for w in [*words, b"wal", b"walkin", b"b"]])
    got = bpe.look_up(lexicon, np.frombuffer(text, np.uint8), np.cumsum(size) - size, size)
    assert got[:8].tolist() == [sorted(words).index(w) for w in words] and got[8:].tolist() == [-1, -1, -1]
    assert len(lexicon.base) == 14, "walk and talk share all states but the first"
    for w in words:
        k = sorted(words).index(w)
        assert lexicon.ids[lexicon.ends[k] : lexicon.ends[k + 1]].tolist() == bpe.merge(w, ranks)


def test_bpe_odd(spark):
    rows = bpe.encode(docs(spark, ODD)).collect()
    assert len(rows) == len(ODD) and all(r["round_trip"] for r in rows)
    assert [(r["tokens"], r["n_tokens"]) for r in rows if r["doc_id"] in (3, 4)] == [(None, 0), ([], 0)]
    assert bpe.encode(docs(spark, [])).count() == 0
    back = bpe.decode(spark.createDataFrame([(1, None), (2, []), (3, [228])], "doc_id long, tokens array<int>")).collect()
    assert [r["text"] for r in back[:2]] == [None, ""]


