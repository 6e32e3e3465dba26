"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of 3 to 6 bytes of the text (A-Z lower-cased, white space as one
blank, a blank at either end), hashed to 2**20 places. A feature counts once for a text. Each
place has a log-count ratio, log of (share of toxic texts with it / share of other texts with
it), both smoothed; places whose ratio is not clear of chance (under LEAST_Z standard errors)
are left out. A logistic regression with an L2 penalty is fitted on features of that size, and
the product of weight and ratio is what a text pays for each n-gram it has.

Training uses a bounded sample of labelled rows (SAMPLE_ROWS); the model has at most
2**20 numbers, so it is sent to the tasks whatever the size of the data. Scoring is one pass
over whole texts without a shuffle.

Edge cases: null, empty and white texts have no features and get the score of the intercept;
repeated rows get the same score; without labels of both kinds every score is the share of
toxic labels (0.5 without any label); a null doc_id is never learnt from; extra columns pass.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import per_text
from .training import Adam, sample_texts, sigmoid

GRAMS, PLACES = (3, 4, 5, 6), 20
LEAST_Z, SMOOTHING, PENALTY, STEPS = 4.0, 1.0, 2e-4, 300
#: The bound of the training sample.
SAMPLE_ROWS = 12_000
GAP = bytes(8)

#: Lower case for A-Z; control characters and white space become a blank (so only GAP has zeros).
FOLD = bytes(32 if b < 33 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def gram_places(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The text of each byte position, and for each gram length the place at each position (-1: none)."""
    parts = [b" " + t.translate(FOLD) + b" " for t in texts]
    t = np.frombuffer(GAP.join([*parts, b""]) + GAP, np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(parts)), [len(p) + len(GAP) for p in parts])
    two = t[:-1] | t[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    out = []
    n_all = len(owner)
    for n in GRAMS:
        packed = four[:n_all] & np.uint64((1 << 8 * min(n, 4)) - 1)
        if n > 4:
            packed = packed | ((two if n == 6 else t)[4 : 4 + n_all] << np.uint64(32))
        place = ((packed * np.uint64(0x9E3779B97F4A7C15 + 2 * n)) >> np.uint64(64 - PLACES)).astype(np.int32)
        place[(t[:n_all] == 0) | (t[n - 1 : n - 1 + n_all] == 0)] = -1
        out.append(place)
    return owner, out


def features(text: bytes) -> np.ndarray:
    places = np.unique(np.concatenate(gram_places([text])[1]))
    return places[places >= 0]


def train(sample: list[tuple[bytes, int]]) -> tuple[np.ndarray, float]:
    """(what each place pays, intercept)."""
    labels = np.array([y for _, y in sample], np.float64)
    pays = np.zeros(1 << PLACES, np.float32)
    if not 0 < labels.sum() < len(labels):
        return pays, 0.0 if not len(labels) else float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    counts = np.zeros((2, 1 << PLACES), np.int32)
    for text, y in sample:
        counts[int(y), features(text)] += 1
    p, q = counts[1] + SMOOTHING, counts[0] + SMOOTHING
    n1, n0 = labels.sum() + 2 * SMOOTHING, len(labels) - labels.sum() + 2 * SMOOTHING
    ratio = np.log(p / n1) - np.log(q / n0)
    ratio[np.abs(ratio) < LEAST_Z * np.sqrt(1 / p - 1 / n1 + 1 / q - 1 / n0)] = 0
    rows = [f[ratio[f] != 0] for f in (features(t) for t, _ in sample)]
    at = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used, at = np.unique(at, return_inverse=True)
    scale = ratio[used]
    params = {"w": np.zeros(len(used)), "b": np.array([np.log(labels.mean() / (1 - labels.mean()))])}
    adam = Adam(params, 0.05)
    for _ in range(STEPS):
        paid = np.bincount(owner, (params["w"] * scale)[at], len(rows)) + params["b"]
        off = (sigmoid(paid) - labels) / len(labels)
        adam.step({"w": np.bincount(at, off[owner], len(used)) * scale + PENALTY * params["w"], "b": np.array([off.sum()])})
    pays[used] = params["w"] * scale
    return pays, float(params["b"][0])


def scores(texts: list[bytes], pays: np.ndarray, intercept: float) -> np.ndarray:
    total = np.full(len(texts), intercept)
    counts = pays != 0
    for i in range(0, len(texts), 64):  # small enough for the processor's caches
        part = texts[i : i + 64]
        owner, grams = gram_places(part)
        found = []
        for place in grams:
            hit = np.flatnonzero(counts[place] & (place >= 0))
            found.append(owner[hit].astype(np.int64) << PLACES | place[hit])
        once = np.unique(np.concatenate(found))
        total[i : i + 64] += np.bincount(once >> PLACES, pays[once & ((1 << PLACES) - 1)], len(part))
    return sigmoid(total)


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in keep with score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list[bytes]], list[pa.Array]]:
        pays, intercept = sent.value
        return lambda texts: [pa.array(scores(texts, pays, intercept))]

    return per_text(docs, "score double", make, keep, text_col)


def fit_toxicity(docs: DataFrame, labelled: DataFrame) -> tuple[np.ndarray, float]:
    """docs: doc_id and text. labelled: doc_id and label (1: toxic), learnable rows only."""
    return train(sample_texts(docs, labelled, SAMPLE_ROWS))
