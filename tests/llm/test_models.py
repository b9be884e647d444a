"""The hidden Markov model and top-k search."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomline.llm import hmm, topk
from loomline.llm.common import held_out
from tests.llm.conftest import ODD


CLASSES = (1 << hmm.BITS) + 1


@pytest.fixture(params=[hmm.LONG, 100, 0], ids=["lanes", "both", "segments"])
def long(request, monkeypatch):
    """Sequences above this go by segments."""
    monkeypatch.setattr(hmm, "LONG", request.param)


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(5)
    return hmm.Model.from_counts(rng.random(4) * 9, rng.random((4, 4)) * 9, rng.random((4, CLASSES)) * 9)


@pytest.fixture(scope="module")
def sequences():
    rng = np.random.default_rng(6)
    return [rng.integers(0, 50, n).astype(np.int32) for n in (1, 2, 63, 64, 65, 128, 129, 500)]


def forward(model, codes):
    a, log = model.start * model.emit[:, codes[0]], 0.0
    for x in codes[1:]:
        log += math.log(a.sum())
        a = (a / a.sum()) @ model.move * model.emit[:, x]
    return log + math.log(a.sum())


def test_likelihood_is_that_of_the_plain_recursion(model, sequences, long):
    assert np.allclose(hmm.log_likelihoods(model, sequences), [forward(model, s) for s in sequences], rtol=1e-12)


def test_expected_counts_are_those_of_plain_forward_backward(model, sequences, long):
    starts, moves, emissions = np.zeros(4), np.zeros((4, 4)), np.zeros((4, CLASSES))
    for codes in sequences:
        n = len(codes)
        a, b = np.zeros((n, 4)), np.ones((n, 4))
        a[0] = model.start * model.emit[:, codes[0]]
        for t in range(1, n):
            a[t] = (a[t - 1] / a[t - 1].sum()) @ model.move * model.emit[:, codes[t]]
        for t in range(n - 2, -1, -1):
            b[t] = model.move @ (model.emit[:, codes[t + 1]] * b[t + 1])
            b[t] /= b[t].sum()
        g = a * b / (a * b).sum(1, keepdims=True)
        starts += g[0]
        for t in range(n - 1):
            x = a[t][:, None] * model.move * (model.emit[:, codes[t + 1]] * b[t + 1])[None]
            moves += x / x.sum()
        for k in range(4):
            np.add.at(emissions[k], codes, g[:, k])
    for mine, plain in zip(hmm.expected_counts(model, sequences), (starts, moves, emissions)):
        assert np.allclose(mine, plain, rtol=1e-9, atol=1e-9)


def test_class_sequences():
    texts = ["The ünd  of\tit", None, "", " \n ", "x", "Internationalé ab\x1cc", "Z" * 70_000, "a"]
    for codes, text in zip(hmm.class_sequences(texts), texts, strict=True):
        assert codes.tolist() == [*map(hmm.word_class, hmm.words(text)), CLASSES - 1]
    assert hmm.word_class(b"nation") == hmm.word_class(b"ration") != hmm.word_class(b"ion")


def test_probabilities_sum_to_one(model):
    assert np.isclose(sum(math.exp(hmm.log_likelihoods(model, [np.array([c], np.int32)])[0]) for c in range(CLASSES)), 1)


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def check_scores(frame, states=hmm.STATES, bits=hmm.BITS):
    docs = frame.select("doc_id", "text").collect()
    # Baum-Welch itself is compared with plain forward-backward above.
    trained = hmm.train(frame.where(~held_out("doc_id", 5, 1)), states=states, bits=bits)
    train = [d for d in docs if d.doc_id is None or zlib.crc32(str(d.doc_id).encode()) % 5 != 1]
    c = Counter(w for d in train for w in tokens(d.text))
    n, v = sum(c.values()), len(c)
    expected = Counter()
    for d in docs:
        t = tokens(d.text)
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        expected[d.doc_id, d not in train, len(t), sum(c[w] > 0 for w in t), n, round(base, 4), round(plain_score(trained, c, t), 4)] += 1
    rows = hmm.score_documents(frame, states=states, bits=bits).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in rows) == expected
    return rows


def plain_score(trained, c, text):
    """log10 P(text): the model's class probabilities by plain recursion, each word by its share of its class."""
    kind = lambda w: trained.emit.shape[1] - 1 if w is None else hmm.word_class(w.encode("utf-8", "surrogatepass"), int(math.log2(trained.emit.shape[1])))
    if id(c) not in plain_score.__dict__:
        n, v = Counter(), Counter()
        for w, times in c.items():
            if times:
                n[kind(w)] += times
                v[kind(w)] += 1
        plain_score.__dict__[id(c)] = n, v, c
    n, v, _ = plain_score.__dict__[id(c)]
    codes = [kind(w) for w in text]
    inside = sum(math.log10((c[w] + 0.5) / (n[k] + 0.5 * (v[k] + 1))) for w, k in zip(text, codes))
    return forward(trained, codes) / math.log(10) + inside


def test_op10(documents):
    rows = [r for r in check_scores(documents) if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.1 * sum(r.n_tokens for r in rows)


@pytest.mark.parametrize("head", [hmm.HEAD, 40, 0])
def test_op10_words_beyond_the_head(documents, head, monkeypatch):
    monkeypatch.setattr(hmm, "HEAD", head)
    check_scores(documents.limit(60), states=3, bits=8)


def test_op10_null_ids(spark):
    rows = [(None, f"the same words w{i % 7} " * (i % 5)) for i in range(300)] + [(3, "x" * 40)] * 50
    check_scores(spark.createDataFrame(rows, "doc_id long, text string"))


def test_op10_odd_rows(odd, empty):
    rows = check_scores(odd)
    assert len(rows) == len(ODD) and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    copies = {round(r.score, 9) for r in rows if r.doc_id in (4, 5)}
    assert len(copies) == 1
    assert hmm.score_documents(empty).collect() == []


# Top-k search

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_top(rows, k=5, every=50):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in usable if i % every == 0}:
        own = min(v for i, v in usable if i == q)
        found = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in usable if i != q and len(v) == len(own))[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(found, 1)}
    return out


def test_op2_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=3)], 0) for i in range(140)]
    rows += [(200 + i, rows[3][1], 0) for i in range(30)]  # ties
    rows += [(rows[7][0], rows[7][1], 0), (None, [1.0, 1.0, 1.0], 0), (300, None, 0), (350, [None, 1.0, 1.0], 0), (400, [float("nan"), 1.0, 1.0], 0), (450, [float("inf"), 0.0, 0.0], 0)]
    rows += [(500, [1.0, 2.0], None), (501, [3.0, 4.0], None), (550, [0.5], 1), (600, [], 1), (601, [], 1)]
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS id", "2 AS v", "3 AS shard", "4 AS rank", "5 AS score")
    for sizes in ({}, {"BLOCK": 2, "SHARD": 20, "TILE": 7, "FAN_IN": 2}):
        for name, value in sizes.items():
            monkeypatch.setattr(topk, name, value)
        got = topk.top_k(frame).collect()
        # A repeated candidate counts as often as it occurs, so ranks are compared with scores and ids.
        assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == plain_top(rows)
    assert topk.top_k(frame.limit(0)).collect() == []
    assert topk.top_k(frame.where("vec_id = 0")).collect() == []


def test_large_products_stay_exact():
    a, b = np.array([[2.0**31, 3.0]]), np.array([[2.0**31, 1.0], [2.0**31, 2.0]])
    assert topk._products(a, b).tolist() == [[2**62 + 3, 2**62 + 6]]
