"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent units of HIDDEN cells read the bytes of a text, one from the left and one
from the right; at every position a softmax over both states gives a probability for each
language, and a text's probabilities are the mean over its positions. The network is trained
in numpy by backpropagation through time on windows of learnable texts.

Texts are read whole, in windows of WINDOW bytes; states start at zero in each window, in
training as in use, which bounds the memory and lets a batch of windows run side by side.

Training uses a bounded sample (SAMPLE_ROWS texts, at most training.SAMPLE_BYTES together); the model
has a few thousand numbers and goes to the tasks whatever the size of the data. Prediction is
one pass without a shuffle.

Edge cases: a null text, or one without a letter, is `und` with score 0; a null language is
not learnt from; repeated rows get the same prediction; without anything to learn from every
prediction is `und`; extra columns pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import per_text
from .training import Adam, sample_texts, sigmoid

HIDDEN, WINDOW, SAMPLE_ROWS = 8, 96, 4000
STEPS, BATCH, RATE = 250, 256, 0.02
NO_LANGUAGE = "und"
ASCII_LETTER = re.compile(rb"[A-Za-z]")

Params = dict[str, np.ndarray]


def start(n_languages: int, rng: np.random.Generator) -> Params:
    """x: what a byte adds to the gates and the candidate; u: what the state adds; v, c: the softmax."""
    h, params = HIDDEN, {}
    for d in "fb":
        params[f"x{d}"] = rng.normal(0, 0.3, (3 * h, 256))
        params[f"u{d}"] = rng.normal(0, 0.5 / np.sqrt(h), (3 * h, h))
        params[f"v{d}"] = rng.normal(0, 0.3, (n_languages, h))
    params["c"] = np.zeros((n_languages, 1))
    return {k: v.astype(np.float32) for k, v in params.items()}


def step(x: np.ndarray, u: np.ndarray, state: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step for all windows: (new state, update gate, reset gate, candidate, u's share of the candidate)."""
    h = HIDDEN
    a = u @ state
    into = np.take(x, seen, axis=1)
    into[: 2 * h] += a[: 2 * h]
    gates = sigmoid(into[: 2 * h])
    update, reset = gates[:h], gates[h:]
    candidate = np.tanh(into[2 * h :] + reset * a[2 * h :])
    return candidate + update * (state - candidate), update, reset, candidate, a[2 * h :]


def sweep(p: Params, d: str, windows: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (position, cell, window) of one direction; the steps' parts too if asked for."""
    t_all, n = windows.shape
    states, parts = np.empty((t_all, HIDDEN, n), np.float32), []
    state = np.zeros((HIDDEN, n), np.float32)
    for t in range(t_all) if d == "f" else range(t_all - 1, -1, -1):
        before = state
        state, *gates = step(p[f"x{d}"], p[f"u{d}"], before, windows[t])
        states[t] = state
        if keep:
            parts.append((t, before, *gates))
    return states, parts


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-2, keepdims=True))
    return e / e.sum(axis=-2, keepdims=True)


def gradients(p: Params, windows: np.ndarray, valid: np.ndarray, label: np.ndarray) -> tuple[float, Params]:
    """Mean loss over positions, and its gradients by backpropagation through time."""
    states, parts = {}, {}
    for d in "fb":
        states[d], parts[d] = sweep(p, d, windows, True)
    probs = softmax(np.einsum("ch,thn->tcn", p["vf"], states["f"]) + np.einsum("ch,thn->tcn", p["vb"], states["b"]) + p["c"])
    total, n = valid.sum(), len(label)
    loss = -float((np.log(probs[:, label, np.arange(n)] + 1e-9) * valid).sum() / total)
    off = probs.copy()
    off[:, label, np.arange(n)] -= 1
    off *= (valid / total)[:, None, :]
    grads: Params = {"c": off.sum(axis=(0, 2))[:, None]}
    h = HIDDEN
    for d in "fb":
        grads[f"v{d}"] = np.einsum("tcn,thn->ch", off, states[d])
        x_grad, u_grad = np.zeros_like(p[f"x{d}"]), np.zeros_like(p[f"u{d}"])
        back = np.zeros((h, n), np.float32)
        for t, before, update, reset, candidate, share in reversed(parts[d]):
            back = back + p[f"v{d}"].T @ off[t]
            d_candidate = back * (1 - update) * (1 - candidate * candidate)
            d_update = back * (before - candidate) * update * (1 - update)
            d_reset = d_candidate * share * reset * (1 - reset)
            into_x = np.concatenate([d_update, d_reset, d_candidate])
            into_a = np.concatenate([d_update, d_reset, d_candidate * reset])
            for i in range(3 * h):
                x_grad[i] += np.bincount(windows[t], into_x[i], 256)
            u_grad += into_a @ before.T
            back = back * update + p[f"u{d}"].T @ into_a
        grads[f"x{d}"], grads[f"u{d}"] = x_grad, u_grad
    return loss, grads


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes by position and window, number of real bytes of each window, text of each window)."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    joined = np.frombuffer(b"".join(t.ljust(int(n) * WINDOW, b" ") for t, n in zip(texts, counts, strict=True)), np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    sizes = np.full(len(owner), WINDOW)
    ends = np.cumsum(counts) - 1
    some = counts > 0
    sizes[ends[some]] = [(len(t) - 1) % WINDOW + 1 for t in texts if t]
    return joined.reshape(-1, WINDOW).T, sizes, owner


def train(sample: list[tuple[bytes, str]], steps: int = STEPS) -> tuple[list[str], Params]:
    """(languages, network)."""
    sample = [(t, y) for t, y in sample if t]
    languages = sorted({y for _, y in sample})
    rng = np.random.default_rng(5)
    params = start(max(1, len(languages)), rng)
    if len(languages) < 2:
        return languages, params
    windows, sizes, owner = windows_of([t for t, _ in sample])
    label = np.array([languages.index(y) for _, y in sample])[owner]
    weights = 1 / np.bincount(label)[label]  # languages alike, however many texts each has
    weights /= weights.sum()
    adam = Adam(params, RATE)
    for i in range(steps):
        pick = rng.choice(len(label), BATCH, p=weights)
        valid = (np.arange(WINDOW)[:, None] < sizes[pick]).astype(np.float32)
        _, grads = gradients(params, windows[:, pick].astype(np.intp), valid, label[pick])
        adam.rate = RATE * (1 - i / steps) + 1e-3
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        adam.step({k: g * min(1, 1 / max(size, 1e-9)) for k, g in grads.items()})
    return languages, params


def probabilities(texts: list[bytes], p: Params, most: int = 4096) -> np.ndarray:
    """(text, language): the mean over a text's positions; zeros for empty texts."""
    windows, sizes, owner = windows_of(texts)
    out = np.zeros((len(texts), len(p["c"])))
    for i in range(0, len(owner), most):
        w, n, who = windows[:, i : i + most].astype(np.intp), sizes[i : i + most], owner[i : i + most]
        left, _ = sweep(p, "f", w, False)
        right, _ = sweep(p, "b", w, False)
        here = np.zeros((len(p["c"]), len(who)), np.float32)
        for t in range(WINDOW):
            # Padding stands at the right end only, and is not counted.
            here += softmax(p["vf"] @ left[t] + p["vb"] @ right[t] + p["c"]) * (t < n)
        for k in range(len(here)):
            out[:, k] += np.bincount(who, here[k], len(texts))
    return out / np.maximum(1, [len(t) for t in texts])[:, None]


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "ignore"))


def predict(texts: list[bytes], languages: list[str], p: Params) -> tuple[list[str], list[float]]:
    if not languages:
        return [NO_LANGUAGE] * len(texts), [0.0] * len(texts)
    probs = probabilities(texts, p)
    best = probs.argmax(axis=1)
    letters = [has_letter(t) for t in texts]
    return [languages[b] if ok else NO_LANGUAGE for b, ok in zip(best, letters, strict=True)], [min(1.0, float(q[b])) if ok else 0.0 for q, b, ok in zip(probs, best, letters, strict=True)]


def fit_languages(docs: DataFrame, learnable: DataFrame) -> tuple[list[str], Params]:
    """docs: doc_id and text. learnable: doc_id and lang of the rows that may be learnt from."""
    return train(sample_texts(docs, learnable.select("doc_id", F.col("lang").alias("label")), SAMPLE_ROWS))


def identify(docs: DataFrame, model: tuple[list[str], Params], keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in keep with lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list[bytes]], list[pa.Array]]:
        languages, params = sent.value

        def work(texts: list[bytes]) -> list[pa.Array]:
            names, scores = predict(texts, languages, params)
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return work

    return per_text(docs, "lang_pred string, score double", make, keep, text_col)
