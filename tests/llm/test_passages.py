"""Removal of repeated passages: bytes that only hash alike stay, and words count whatever their length."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from test_operators import brute_removal

from netquill.llm import suffix_dedup

SCHEMA = "doc_id bigint, text string, spans int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def without_passages(texts, words):
    """Texts without the words that lie in a run of so many words which starts twice or more."""
    found = [list(re.finditer(r"[^\x20\x09-\x0D]+", t)) for t in texts]
    windows = [[tuple(m.group() for m in ms[i : i + words]) for i in range(len(ms) - words + 1)] for ms in found]
    times, out = Counter(w for ws in windows for w in ws), []
    for t, ms, ws in zip(texts, found, windows, strict=True):
        covered = sorted({k for i, w in enumerate(ws) if times[w] > 1 for k in range(i, i + words)})
        for last in reversed(covered):
            end = ms[last].end()
            start = ms[last].start() if last - 1 not in covered else ms[last - 1].end()
            t = t[:start] + t[end:]
        out.append(t)
    return out


def removed(spark, texts, words, **kw):
    rows = suffix_dedup.remove_passages(frame(spark, texts), ["doc_id"], words, **kw).collect()
    assert all(r.n_bytes == len((texts[r.doc_id] or "").encode()) and r.kept_text.encode() == bytes(r.kept_bytes) for r in rows)
    return [r.kept_text for r in sorted(rows)]


@pytest.mark.parametrize("words", [51, 4, 1])
def test_against_brute_force(spark, words):
    rng = random.Random(words)
    vocabulary = [f"{rng.choice('abcé')}{i}" for i in range(400)] + ["a", "I", "\U0001f600"]
    prose = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", " \t"]) for _ in range(n))
    shared = [prose(n) for n in (words - 1, words, words + 1, 3 * words)]
    texts = [prose(rng.randint(0, 4 * words)) + rng.choice(shared) + prose(rng.randint(0, 4 * words)) for _ in range(40)]
    texts += [texts[0], texts[1].replace(" ", "  "), "x " * (3 * words), "", " \n", "a b c d e f g"]
    assert removed(spark, texts, words) == without_passages(texts, words)
    assert removed(spark, texts, words, crowd=2) == without_passages(texts, words)


def test_short_words(spark):
    """60 words in 172 bytes, the least a passage of over 50 words may well have, and 51 of one letter."""
    rng = random.Random(5)
    for n, letters in ((60, 2), (51, 1)):
        passage = " ".join("".join(rng.choice("abcdefghij") for _ in range(1 + rng.randrange(letters))) for _ in range(n))
        texts = [f"word{i} before{i} {passage} after{i}" for i in range(3)]
        assert removed(spark, texts, 51) == [f"word{i} before{i}  after{i}" for i in range(3)]


def test_odd_rows(spark):
    long = " ".join(str(i) for i in range(300_000))
    assert removed(spark, [None, "", long, long + " x"], 51) == ["", "", "", " x"]
    assert removed(spark, [long], 51) == [long]
    assert suffix_dedup.remove_passages(frame(spark, []), ["doc_id"], 51).count() == 0


def alike(rng):
    """Two texts of 640 bytes that differ everywhere but in the middle, by what is zero for polynomials of an odd base modulo 2^64."""
    apart = np.array([2], np.int64)
    for k in (1, 2, 4, 8, 16, 32, 64, 128, 256, 128):
        apart = np.convolve(apart, np.array([-1] + [0] * (k - 1) + [1]))
    assert len(apart) == 640 and np.abs(apart).max() <= 4
    base = np.array([rng.randint(105, 114) for _ in range(640)])
    return base.astype(np.uint8).tobytes(), (base + apart).astype(np.uint8).tobytes()


def test_contents_that_only_hash_alike(spark):
    rng = random.Random(1)
    pairs = [t.decode() for _ in range(200) for t in alike(rng)]
    rows = suffix_dedup.remove_repeats(frame(spark, pairs), ["doc_id"]).collect()
    assert [r.n_removed for r in sorted(rows)] == [0] * len(pairs)
    pairs[7] = pairs[6]
    rows = suffix_dedup.remove_repeats(frame(spark, pairs), ["doc_id"]).collect()
    assert [r.n_removed for r in sorted(rows)] == [w[1] for w in brute_removal([t.encode() for t in pairs])] and sum(r.n_removed for r in rows) == 1280


def test_weak_anchor_hashes(monkeypatch):
    """Anchors that collide put different contents together; digests tell them apart."""
    monkeypatch.setattr(suffix_dedup, "mixed", lambda h: h & np.uint64(0x300000))
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"abcd") for _ in range(900)) for _ in range(6)]
    texts.append(texts[0][100:600])
    size = suffix_dedup.size_of(400)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    start, windows, times, anchor, content = suffix_dedup.segments_of(np.frombuffer(b"".join(texts), np.uint8), starts[1:], size)
    assert len(set(anchor.tolist())) <= 4
    whole = b"".join(texts)
    contents = {}
    for a, w, c in zip(start.tolist(), windows.tolist(), content.tolist(), strict=True):
        contents.setdefault(tuple(c), set()).add(whole[a : a + w + 399])
    assert all(len(c) == 1 for c in contents.values()) and times.min() == 1
