"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE_WORDS words; only the bag has a label. Each passage is
described by shares and counts of its characters and words (SHAPES), and by what it says: its words
and pairs of words are hashed, with a sign, to PLACES places, each of which has a learnt
embedding. A learnt layer encodes the sum of both. Gated attention, w . (tanh(V h) * sigmoid(U h)), weighs the passages of a bag, and the
weighted mean of their encodings is scored by a logistic unit. All layers are trained together
in numpy from document labels.

Training uses a bounded sample (SAMPLE_ROWS labelled texts, at most training.SAMPLE_BYTES together);
the model has about ten thousand numbers. Scoring reads whole texts, every passage, in one pass
without a shuffle. Labels, language, source and doc_id are no inputs of a score.

Edge cases: null, empty and white texts are one passage without words, and score like one;
repeated rows get the same score; without labels of both kinds all scores are the share of
good labels (0.5 without any); a null doc_id is never learnt from; extra columns pass.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import per_text
from .training import Adam, sample_texts, sigmoid

PASSAGE_WORDS, ENCODED, GATE = 40, 16, 8
SAMPLE_ROWS, EPOCHS, BATCH, RATE, PENALTY = 8000, 30, 128, 0.01, 1e-4

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Kinds of bytes that are counted: each is a row of 256 flags.
KINDS = [b"\n", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!?", b".,;:", b"|", b"#", b"$", b"%", b"&", b"*", b"<>{}[]()", b"\"'`", b"/\\@=_+~^-", bytes(range(128, 256))]
OF_KIND = np.array([[b in k for b in range(256)] for k in KINDS])
SHAPES, PLACES = 2 * len(KINDS) + 8, 512
MEASURES = SHAPES + PLACES
#: Of a passage whose hashed words have length 1, how far they are stretched beside the measures, which have variance 1.
STRETCH = 4.0
#: Passages that are encoded at a time.
AT_ONCE = 4096


class Bags(NamedTuple):
    """Passages, those of a text together: their measures (SHAPES) and texts, and hashed words and pairs (passage, place, sign), sorted by passage."""

    measures: np.ndarray
    owner: np.ndarray
    at: np.ndarray
    place: np.ndarray
    sign: np.ndarray

    def inputs(self, begin: int, end: int) -> np.ndarray:
        """What the network sees of some passages, MEASURES columns."""
        x = np.empty((end - begin, MEASURES), np.float32)
        x[:, :SHAPES] = self.measures[begin:end]
        a, b = np.searchsorted(self.at, [begin, end])
        sums = np.bincount((self.at[a:b] - begin) * PLACES + self.place[a:b], self.sign[a:b], (end - begin) * PLACES).reshape(-1, PLACES)
        x[:, SHAPES:] = sums / np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1)
        return x


def passages_of(texts: list[bytes]) -> Bags:
    t = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    white = WHITE[t]
    starts = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    ends = np.flatnonzero(~white[:-1] & white[1:]) + 1
    text_ends = np.cumsum([len(x) + 1 for x in texts])  # where the blank after each text stands
    owner = np.searchsorted(text_ends, starts, side="right") if len(starts) else np.zeros(0, np.int64)
    n_words = np.bincount(owner, minlength=len(texts))
    n_passages = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    first_passage = np.concatenate([[0], np.cumsum(n_passages)])
    first_word = np.concatenate([[0], np.cumsum(n_words)])
    total = first_passage[-1]
    rank = np.arange(len(starts)) - first_word[owner]
    passage = first_passage[owner] + rank // PASSAGE_WORDS
    words = np.bincount(passage, minlength=total).astype(np.float64)
    # A passage's bytes run from its first word up to the next passage's.
    firsts = np.flatnonzero(np.diff(passage, prepend=-1))
    filled = passage[firsts]
    counts = np.zeros((total, len(KINDS)))
    if len(firsts):
        for k, flags in enumerate(OF_KIND):
            counts[filled, k] = np.add.reduceat(flags[t].astype(np.int32), starts[firsts])
    size = np.maximum(np.bincount(passage, ends - starts, total), 1)[:, None]
    some = np.maximum(words, 1)
    # Words are compared by a hash: a polynomial in odd powers, from prefix sums.
    powers = np.cumprod(np.full(len(t), 0x9E3779B97F4A7C15 | 1, np.uint64))
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(((t.astype(np.uint64) + np.uint64(1)) * powers))])
    inverse = pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
    back = np.cumprod(np.full(len(t) + 1, inverse, np.uint64))
    hashes = (prefix[ends] - prefix[starts]) * back[starts]
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(28)  # 36 bits
    inside = np.sort(passage.astype(np.uint64) << np.uint64(36) | mixed)
    fresh = np.flatnonzero(np.diff(inside, prepend=np.uint64(2**64 - 1)) != 0)
    distinct = np.bincount((inside[fresh] >> np.uint64(36)).astype(np.int64), minlength=total)
    alike = np.zeros(len(starts))
    if len(starts) > 2:
        alike[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    again = np.bincount(passage, alike, total)
    length = ends - starts
    mean = np.bincount(passage, length, total) / some
    spread = np.sqrt(np.maximum(0, np.bincount(passage, length.astype(np.float64) ** 2, total) / some - mean**2))
    one = np.bincount(passage, length == 1, total)
    in_text = np.repeat(n_words, n_passages)
    extra = np.stack([distinct / some, again / some, mean / 10, spread / 5, one / some, np.log1p(words) / 4, np.log1p(in_text) / 8, words == 0], 1)
    measures = np.concatenate([counts / size, np.minimum(counts / some[:, None], 3), extra], 1)
    near = np.flatnonzero(passage[1:] == passage[:-1])
    pairs = (mixed[near] * np.uint64(0x9E3779B97F4A7C15)) ^ mixed[near + 1]
    hashed = np.concatenate([mixed, pairs]) * np.uint64(0xD6E8FEB86659FD93)
    at = np.concatenate([passage, passage[near]])
    order = np.argsort(at, kind="stable")
    place, sign = (hashed >> np.uint64(40)) % np.uint64(PLACES), 1 - 2 * (hashed >> np.uint64(63)).astype(np.int8)
    return Bags(measures.astype(np.float32), np.repeat(np.arange(len(texts)), n_passages), at[order].astype(np.int32), place[order].astype(np.int16), sign[order])


def start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    shapes = {"e": (MEASURES, ENCODED), "v": (ENCODED, GATE), "u": (ENCODED, GATE), "w": (GATE, 1), "s": (ENCODED, 1)}
    params = {k: rng.normal(0, 1 / np.sqrt(a), (a, b)) for k, (a, b) in shapes.items()}
    params["e"][SHAPES:] = 0  # nothing is known of words before training
    return params | {"eb": np.zeros(ENCODED), "sb": np.zeros(1), "mean": np.zeros(MEASURES), "scale": np.ones(MEASURES)}


def encoded(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x scaled, and its encoding."""
    x = np.clip((x - p["mean"]) * p["scale"], -6, 6)
    return x, np.tanh(x @ p["e"] + p["eb"])


def forward(p: dict[str, np.ndarray], x: np.ndarray, bag: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Scores of n bags, and the parts that training needs; bag numbers ascend."""
    x, h = encoded(p, x)
    score, *parts = attended(p, h, bag, n)
    return score, x, h, *parts


def attended(p: dict[str, np.ndarray], h: np.ndarray, bag: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Scores of n bags of encodings, the two halves of the gate, the weights and the weighted means."""
    v, u = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
    a = ((v * u) @ p["w"])[:, 0]
    starts = np.searchsorted(bag, np.arange(n))
    e = np.exp(a - np.maximum.reduceat(a, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts)
    return sigmoid((z @ p["s"])[:, 0] + p["sb"]), v, u, a, z


def gradients(p: dict[str, np.ndarray], x: np.ndarray, bag: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss."""
    score, x, h, v, u, a, z = forward(p, x, bag, len(labels))
    off = ((score - labels) / len(labels))[:, None]
    dz = off @ p["s"].T
    per = dz[bag]
    da = (per * h).sum(1)
    starts = np.searchsorted(bag, np.arange(len(labels)))
    da = (a * (da - np.add.reduceat(a * da, starts)[bag]))[:, None]
    dg = da @ p["w"].T
    dv, du = dg * u * (1 - v * v), dg * v * u * (1 - u)
    dh = (a[:, None] * per + dv @ p["v"].T + du @ p["u"].T) * (1 - h * h)
    return {"e": x.T @ dh, "eb": dh.sum(0), "v": h.T @ dv, "u": h.T @ du, "w": (v * u).T @ da, "s": z.T @ off, "sb": off.sum(0)}


def train(sample: list[tuple[bytes, int]]) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    p = start(rng)
    labels = np.array([y for _, y in sample], np.float64)
    if not 0 < labels.sum() < len(labels):
        p["s"][:] = 0
        p["sb"][:] = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)) if len(labels) else 0
        return p
    parts = [passages_of([t]) for t, _ in sample]
    every = np.concatenate([b.measures for b in parts])
    p["mean"][:SHAPES], p["scale"][:SHAPES] = every.mean(0), 1 / (every.std(0).astype(np.float64) + 1e-3)
    p["scale"][SHAPES:] = STRETCH
    for k in ("mean", "scale"):
        p[k] = p[k].astype(np.float32)
    p["sb"][:] = np.log(labels.mean() / (1 - labels.mean()))
    trained = {k: p[k] for k in ("e", "eb", "v", "u", "w", "s", "sb")}
    epochs = max(EPOCHS, 12_000 // len(sample))
    adam, steps = Adam(trained, RATE), epochs * -(-len(sample) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(sample))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            bag = np.repeat(np.arange(len(pick)), [len(parts[j].owner) for j in pick])
            grads = gradients(p, np.concatenate([parts[j].inputs(0, len(parts[j].owner)) for j in pick]), bag, labels[pick])
            adam.rate = RATE * (1 - adam.n / steps) + 1e-4
            adam.step({k: g + PENALTY * trained[k] * (k not in ("eb", "sb")) for k, g in grads.items()})
    return p


def scores(texts: list[bytes], p: dict[str, np.ndarray]) -> np.ndarray:
    out = []
    for i in range(0, len(texts), 128):
        part = texts[i : i + 128]
        bags = passages_of(part)
        n = len(bags.owner)
        h = np.concatenate([encoded(p, bags.inputs(at, min(n, at + AT_ONCE)))[1] for at in range(0, n, AT_ONCE)])
        out.append(attended(p, h, bags.owner, len(part))[0])
    return np.concatenate(out) if out else np.zeros(0)


def fit_quality(docs: DataFrame, labelled: DataFrame) -> dict[str, np.ndarray]:
    """docs: doc_id and text. labelled: doc_id and label (1: good), learnable rows only."""
    return train(sample_texts(docs, labelled, SAMPLE_ROWS))


def score_quality(docs: DataFrame, model: dict[str, np.ndarray], keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns in keep with the score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list[bytes]], list[pa.Array]]:
        p = sent.value
        return lambda texts: [pa.array(scores(texts, p), pa.float64())]

    return per_text(docs, f"`{name}` double", make, keep, text_col)
