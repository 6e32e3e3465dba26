"""The trained models against plain references: what passages say, gradients through time, ratios and loss."""

import math
import random

import numpy as np
import pytest

from netquill.llm import language_id, mil_quality, toxicity


def test_words_decide_where_shapes_are_equal():
    """Good and bad texts have words of the same lengths and the same punctuation; only what they say differs."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    pairs = [tuple("".join(rng.choice(letters) for _ in range(n)) for _ in range(2)) for n in [3, 4, 5, 6, 7] * 20]
    make = lambda good: " ".join(rng.choice(pairs)[1 - good] + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(10, 150))).encode()
    model = mil_quality.train([(make(i % 2), i % 2) for i in range(500)])
    got = mil_quality.scores([make(i % 2) for i in range(200)], model)
    assert sum((s >= 0.5) == (i % 2 == 1) for i, s in enumerate(got)) >= 194


def test_one_bad_passage_among_many():
    """Attention finds the passage that makes a text bad."""
    rng = random.Random(10)
    words = ["the", "sea", "stone", "walks", "over", "green", "hill"]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    make = lambda good: " ".join(prose(rng.randrange(400)) + ([] if good else ["spam", "eggs"] * 15) + prose(rng.randrange(400))).encode()
    model = mil_quality.train([(make(i % 2), i % 2) for i in range(400)])
    got = mil_quality.scores([make(i % 2) for i in range(100)], model)
    assert sum((s >= 0.5) == (i % 2 == 1) for i, s in enumerate(got)) >= 95


def test_scores_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abc") * rng.randint(1, 9) for _ in range(n)).encode() for n in (0, 1, 39, 40, 41, 5000, 300)]
    model = mil_quality.train([(t, i % 2) for i, t in enumerate(texts * 4)])
    whole = mil_quality.scores(texts, model)
    monkeypatch.setattr(mil_quality, "AT_ONCE", 7)
    assert np.allclose(mil_quality.scores(texts, model), whole, atol=1e-6)
    assert np.allclose([mil_quality.scores([t], model)[0] for t in texts], whole, atol=1e-6)


def test_hashed_words():
    """inputs has the sums of signs by place, of words and of pairs inside a passage, at length 1."""
    bags = mil_quality.passages_of([b"a b a", b"", b"b a " * 30])
    x = bags.inputs(0, len(bags.owner))
    assert bags.owner.tolist() == [0, 1, 2, 2] and np.allclose((x[[0, 2, 3], mil_quality.SHAPES :] ** 2).sum(1), 1, atol=1e-5) and not x[1, mil_quality.SHAPES :].any()
    assert np.bincount(bags.at).tolist() == [3 + 2, 0, 40 + 39, 20 + 19]
    again = mil_quality.passages_of([b"zz", b"a b a"])
    assert np.array_equal(again.inputs(1, 2)[0, mil_quality.SHAPES :], x[0, mil_quality.SHAPES :])
    other = mil_quality.passages_of([b"b a a"]).inputs(0, 1)[0, mil_quality.SHAPES :]
    assert not np.array_equal(other, x[0, mil_quality.SHAPES :])  # the same words in another order


def test_gradients_through_time():
    """Backpropagation through time against differences, for every array of the network."""
    rng = np.random.default_rng(3)
    p = {k: v.astype(np.float32) for k, v in language_id.start(3, rng).items()}
    windows = rng.integers(97, 105, (language_id.WINDOW, 5)).astype(np.intp)
    sizes = np.array([language_id.WINDOW, 3, 9, 1, language_id.WINDOW // 2])
    valid = (np.arange(language_id.WINDOW)[:, None] < sizes).astype(np.float32)
    label = np.array([0, 2, 1, 1, 0])
    _, grads = language_id.gradients(p, windows, valid, label)
    assert set(grads) == set(p)
    for k, g in grads.items():
        for i in np.argsort(np.abs(g).ravel())[-3:]:
            at = np.unravel_index(i, g.shape)
            losses = []
            for step in (1e-2, -1e-2):
                moved = {a: b.copy() for a, b in p.items()}
                moved[k][at] += step
                losses.append(language_id.gradients(moved, windows, valid, label)[0])
            assert g[at] == pytest.approx((losses[0] - losses[1]) / 2e-2, rel=0.05, abs=2e-4), (k, at)


def grams(text):
    """Distinct n-grams of a text, as it is read: lower case, white space as blanks, a blank at either end."""
    plain = b" " + bytes(32 if b < 33 else b + 32 if 65 <= b <= 90 else b for b in text) + b" "
    return {plain[i : i + n] for n in toxicity.GRAMS for i in range(len(plain) - n + 1)}


def test_ratios_and_loss():
    """What n-grams pay against a plain fit: the same ratios, and a loss at most a little above that of many plain steps."""
    rng = random.Random(12)
    words = ["stone", "green", "walks", "over", "hill", "rain"]
    make = lambda bad: " ".join([rng.choice(words) for _ in range(12)] + (["grumple"] if bad and rng.random() < 0.9 else []) + (["Bogus"] if rng.random() < (0.5 if bad else 0.2) else [])).encode()
    sample = [(make(i % 3 == 0), int(i % 3 == 0)) for i in range(240)]
    pays, intercept = toxicity.train(sample)
    n = [sum(1 - y for _, y in sample), sum(y for _, y in sample)]
    counts = {}
    for t, y in sample:
        for g in grams(t):
            counts.setdefault(g, [0, 0])[y] += 1
    smooth, ratios = toxicity.SMOOTHING, {}
    for g, (q, p) in counts.items():
        p, q, n1, n0 = p + smooth, q + smooth, n[1] + 2 * smooth, n[0] + 2 * smooth
        r = math.log(p / n1) - math.log(q / n0)
        ratios[g] = r if abs(r) >= toxicity.LEAST_Z * math.sqrt(1 / p - 1 / n1 + 1 / q - 1 / n0) else 0.0
    used = sorted(g for g, r in ratios.items() if r)
    assert {b"grump", b"mple"} <= set(used) and 0 < len(used) < len(ratios) / 2
    x = np.array([[ratios[g] if g in grams(t) else 0.0 for g in used] for t, _ in sample])
    y = np.array([b for _, b in sample], float)
    w, b = np.zeros(len(used)), math.log(n[1] / n[0])

    def loss(paid, weights):
        return np.mean(np.logaddexp(0, paid) - y * paid) + toxicity.PENALTY / 2 * (weights**2).sum()

    for _ in range(6000):
        off = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        w, b = w - 0.02 * (x.T @ off + toxicity.PENALTY * w), b - 0.5 * off.sum()
    paid = np.array([intercept + sum(pays[p] for p in toxicity.features(t)) for t, _ in sample], float)
    assert (pays != 0).sum() <= len(used)  # places may be shared
    assert np.mean(np.logaddexp(0, paid) - y * paid) <= loss(x @ w + b, w) + 0.02
    assert np.allclose(toxicity.scores([t for t, _ in sample], pays, intercept), 1 / (1 + np.exp(-paid)), atol=1e-5)
