"""Language-model scores against counts and probabilities worked out one by one."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from regolith.llm import lm_scoring as lm


def corpus():
    rng = random.Random(2)
    tongues = [[f"{a}{b}{t}" for a in "bcdfg" for b in "aeiou" for t in ts] for ts in (("lon", "pri"), ("mir", "lon"))]
    return [" ".join(rng.choice(tongues[i % 2]) for _ in range(rng.randint(1, 80))) for i in range(400)] + [None, "", "Never seen", "x " * 3000]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, 0.0, "e") for i, t in enumerate(texts)], "doc_id long, text string, score double, block string")


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def test_counts_and_gain(spark):
    texts = corpus()
    df = documents(spark, texts)
    rows = {r.doc_id: r for r in lm.score(df, share=20).collect()}
    tokens = {i: (t or "").lower().split() + ["\n"] for i, t in enumerate(texts)}
    count = Counter(w for i, ws in tokens.items() if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(ws), sum(w in count for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), abs_tol=1e-6)
        assert r.score < 0
    out = [r for r in rows.values() if r.held_out and r.n_tokens < 1000]
    # two vocabularies that share half of their words: context tells which, worth 0.5 bits a token at most
    assert (sum(r.score for r in out) - sum(r.base_score for r in out)) / sum(r.n_tokens for r in out) / math.log10(2) > 0.25
    # the same scores however the table is cut
    again = {r.doc_id: r.score for r in lm.score(df.repartition(5), share=20).collect()}
    assert again == {i: r.score for i, r in rows.items()}
    assert lm.score(df.limit(0)).collect() == []


def test_ids_of_any_type(spark):
    for kind in ("double", "decimal(9,2)", "string", "binary", "smallint"):
        df = documents(spark, ["a b", None, "a b"]).selectExpr(f"cast(cast(doc_id as smallint) as {kind}) as doc_id" if kind != "binary" else "cast(string(doc_id) as binary) as doc_id", "text")
        got = lm.score(df).collect()
        assert len(got) == 3 and len({r.score for r in got}) == 2


def test_without_training_texts(spark):
    df = documents(spark, [t for t in ["a b c"] * 20]).filter("crc32(string(doc_id)) % 5 = 1")
    got = lm.score(df).collect()
    assert got and all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in got)


def test_frequent_words_are_exact(spark):
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(5000)]
    texts = [" ".join(words[i : i + 50]) for i in range(0, 5000, 50)]
    count = Counter(w for i, t in enumerate(texts) if not held(i) for w in [*t.split(), "\n"])
    total = sum(count.values())
    for share in (10, 100):
        want = {(xxhash.xxh3_64_intdigest(w) + (1 << 63)) % (1 << 64) - (1 << 63): n for w, n in count.items() if n * share >= total}
        assert dict(lm.frequent_words(lm.encode(documents(spark, texts).repartition(7)), share)) == want


def test_scores_token_by_token(spark):
    """score() against loops over tokens, words and states, from the trained parameters."""
    texts = corpus()[:60] + ["never seen", ""]
    docs = documents(spark, texts)
    blocks = lm.encode(docs)
    units = lm.Units(lm.frequent_words(blocks, 20))
    p, stood = lm.refine(blocks, units, lm.warm_parameters(docs, units))
    prior = lm.priors(stood)
    tokens = {i: [w.encode() for w in (t or "").lower().split()] + [lm.END] for i, t in enumerate(texts)}

    def number(w):
        return int(units.of(np.array([xxhash.xxh3_64_intdigest(w)], np.uint64).view(np.int64), np.array([lm.class_of(w)]))[0])

    def steps(ws):
        """(word, unit, context, state) of each token."""
        us = [number(w) for w in ws]
        for t, w in enumerate(ws):
            before = np.array([[us[t - 1 - i] if t > i else units.size] for i in range(lm.ORDER)])
            q = p.predicted(before)
            yield w, us[t], q[0], int(p.states(q)[0])

    seen, many = {}, np.zeros((lm.CLASSES, lm.STATES))
    for i, ws in tokens.items():
        if not held(i):
            for w, u, _, s in steps(ws):
                seen.setdefault(w, np.zeros(lm.STATES))[s] += 1
                if u >= units.frequent:
                    many[u - units.frequent, s] += 1
    assert (many == stood).all()
    weigh, total = {}, np.full((lm.CLASSES, lm.STATES), 0.5)
    for w, n in seen.items():
        u = number(w)
        if u >= units.frequent:
            c = u - units.frequent
            code = lm.vectors(n[None], prior[c][None], p.coordinates)[0] if n.sum() > 1 else np.zeros(lm.DEPTH)
            z = np.exp(p.coordinates @ (code * lm.STEP))
            weigh[w] = (n.sum() + 0.5) * z / (z @ prior[c])
            total[c] += weigh[w]
    want = {}
    for i, ws in tokens.items():
        out = 0.0
        for w, u, q, s in steps(ws):
            z = p.Q.astype(float) @ q + p.b
            out += z[u] - math.log(np.exp(z).sum())
            if u >= units.frequent:
                c = u - units.frequent
                out += math.log((weigh[w][s] if w in weigh else 0.5) / total[c, s])
        want[i] = out / math.log(10)
    got = {r.doc_id: r.score for r in lm.score(docs, share=20).collect()}
    assert got == {i: pytest.approx(x, rel=1e-5) for i, x in want.items()}


def test_contexts_are_learnt_from_all_training_texts(spark, monkeypatch):
    """Texts beyond the sample that gives start values move R, C, the noise and the centres; held-out ones move nothing."""
    texts = corpus()
    blocks = lm.encode(documents(spark, texts))
    units = lm.Units(lm.frequent_words(blocks, 20))
    monkeypatch.setattr(lm, "WARM_TEXTS", 8)
    monkeypatch.setattr(lm, "WARM_TOKENS", 200)
    start = lm.warm_parameters(documents(spark, texts), units)
    p, stood = lm.refine(blocks, units, start)
    for name in ("R", "C", "Q", "b", "centres", "coordinates", "log_noise"):
        assert not np.array_equal(getattr(p, name), getattr(start, name)), name
    # the noise is the distribution of all training tokens
    count = Counter(w.encode() for i, t in enumerate(texts) if not held(i) for w in [*(t or "").lower().split(), "\n"])
    mass = np.full(units.size, 0.5)
    for w, n in count.items():
        mass[units.of(np.array([xxhash.xxh3_64_intdigest(w)], np.uint64).view(np.int64), np.array([lm.class_of(w)]))[0]] += n
    assert np.allclose(p.log_noise, np.log(mass / mass.sum()))
    # other texts outside the sample give other contexts, other held-out texts the same
    for change, same in (((lambda i: not held(i)), False), (held, True)):
        others = [" ".join(reversed((t or "").split())) if change(i) else t for i, t in enumerate(texts)]
        q, again = lm.refine(lm.encode(documents(spark, others)), units, start)
        assert all(np.array_equal(getattr(p, k), getattr(q, k)) == same for k in ("R", "C", "Q", "centres")) and np.array_equal(stood, again) == same


def test_pushes_are_the_slope_of_the_loss(spark):
    """What contexts are pulled by, against differences of the expected noise-contrastive loss."""
    rng, n, T = np.random.default_rng(1), 40, 300
    log_noise = np.log(rng.dirichlet(np.ones(n)))
    p = lm.Parameters(rng.normal(0, 0.5, (n + 1, lm.WIDTH)).astype(np.float32), np.ones((lm.ORDER, lm.WIDTH), np.float32), lm._finer(rng.normal(0, 0.3, (n, lm.WIDTH))), log_noise.astype(np.float32), log_noise, np.zeros((lm.STATES, lm.WIDTH), np.float32), np.zeros((lm.STATES, lm.DEPTH)))
    units, lengths, group = rng.integers(0, n, T), np.array([100, 200]), rng.integers(0, lm.GROUPS, T)
    before = lm.contexts(units, lengths, n)
    sums = lm.Sums.of(n)
    lm._add(sums, p, before, p.predicted(before), units, group)
    assert (sums.flat() == np.rint(sums.flat())).all() and sums.near.sum() == lm.ORDER * T

    def loss(moved):
        z = sum(moved[i][before[i]] for i in range(lm.ORDER)) @ p.Q.T.astype(float) + p.b - math.log(lm.NOISE) - log_noise
        mine = np.arange(n) % lm.GROUPS == group[:, None]
        return -np.log1p(np.exp(-z[np.arange(T), units])).sum() - (np.log1p(np.exp(z)) * mine * lm._weights(p)).sum()

    for i, u, k in ((0, int(units[3]), 2), (1, int(units[50]), 7), (3, n, 0)):
        up, down = p.moved().astype(float), p.moved().astype(float)
        up[i, u, k] += 1e-4
        down[i, u, k] -= 1e-4
        assert sums.pushes[i, u, k] / lm.PULLED == pytest.approx((loss(up) - loss(down)) / 2e-4, abs=0.05)


def parameters(n, spread=1.0):
    rng = np.random.default_rng(1)
    log_noise = np.log(rng.dirichlet(np.ones(n)))
    return lm.Parameters(rng.normal(0, 0.5 * spread, (n + 1, lm.WIDTH)).astype(np.float32), np.ones((lm.ORDER, lm.WIDTH), np.float32), lm._finer(rng.normal(0, 0.5, (n, lm.WIDTH))), log_noise.astype(np.float32), log_noise, (np.rint(rng.normal(0, 32, (lm.STATES, lm.WIDTH))) / 64).astype(np.float32), np.zeros((lm.STATES, lm.DEPTH)))


def test_no_exponential_is_taken_for_a_token(monkeypatch):
    """Logs of units against sums in 64 bits; exponentials are those of the tables, whatever the number of tokens."""
    exp, taken = np.exp, []
    monkeypatch.setattr(np, "exp", lambda x, *a, **k: taken.append(np.size(x)) or exp(x, *a, **k))
    for spread in (1.0, 40.0):  # factors that underflow too
        p, rng = parameters(40, spread), np.random.default_rng(2)
        for T in (3, 5000):
            units = rng.integers(0, 40, T)
            before = lm.contexts(units, np.array([T]), 40)
            taken.clear()
            got = p.log_units(p.predicted(before), units, before, p.factors())
            if spread == 1:
                assert sum(taken) == lm.ORDER * 41 * 40
            z = p.predicted(before).astype(float) @ p.Q.T.astype(float) + p.b
            assert got == pytest.approx(z[np.arange(T), units] - z.max(1) - np.log(exp(z - z.max(1, keepdims=True)).sum(1)), rel=1e-5, abs=1e-4)


def test_sums_do_not_depend_on_spans(monkeypatch):
    """The sums over tokens are the same whole numbers in one span or many, and those of plain loops."""
    p, rng, lengths = parameters(40), np.random.default_rng(3), np.array([1, 1, 2, 150, 3, 200])
    T = int(lengths.sum())
    units, group = rng.integers(0, 40, T), rng.integers(0, lm.GROUPS, T)
    before = lm.contexts(units, lengths, 40)
    q = p.predicted(before)
    found = []
    for span in (1 << 15, 64, 1):
        monkeypatch.setattr(lm, "SPAN", span)
        sums = lm.Sums.of(40)
        lm._add(sums, p, before, q, units, group)
        found.append(sums.flat())
    assert all(np.array_equal(found[0], f) for f in found)
    sums, state, near = lm.Sums.of(40, found[0]), p.states(q), np.zeros((lm.STATES, lm.ORDER, 41))
    assert state.tolist() == (q @ p.centres.T - (p.centres**2).sum(1) / 2).argmax(1).tolist()
    pulls, weighed = np.zeros((40, lm.WIDTH + 1)), np.zeros((40, lm.WIDTH + 1))
    for t in range(T):
        z = q[t] @ p.Q.T + (p.b - (np.log(lm.NOISE) + p.log_noise).astype(np.float32))
        s, full = np.rint(lm.PULLED / (1 + np.exp(-z))), np.r_[q[t], 1] * lm.FINE
        pulls[units[t]] += (lm.PULLED - s[units[t]]) * full
        mine = np.arange(group[t], 40, lm.GROUPS)
        weighed[mine] += s[mine, None] * full
        for i in range(lm.ORDER):
            near[state[t], i, before[i, t]] += 1
    assert np.array_equal(sums.near, near)
    assert np.allclose(sums.pulls, [pulls, weighed], rtol=1e-3, atol=2 * lm.FINE * 4)


def test_words_of_texts():
    rng = random.Random(1)
    letters = [chr(c) for c in range(40)] + list("AZaz \u00e9\u00c9\u3000\u0085\u0130K")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + [None, "", " ", " \n", "a"]
    words, many = lm.words_of(pa.array(texts))
    want = [lm.byte_words(t) for t in texts]
    assert many.tolist() == [len(w) for w in want] and words.to_pylist() == [w for ws in want for w in ws]
    assert lm._classes(words).tolist() == [lm.class_of(w) for ws in want for w in ws]
    for few in ([], [None], ["", " "]):
        words, many = lm.words_of(pa.array(few, pa.string()))
        assert len(words) == 0 and many.tolist() == [0] * len(few)
    tokens = np.array([0, 1, 255, 256, 1 << 24, (1 << 32) - 1], np.uint32)
    assert np.array_equal(lm.unpacked_tokens(lm.packed_tokens(tokens), len(tokens)), tokens)
