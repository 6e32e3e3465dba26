"""One-permutation MinHash against exact Jaccard indexes, and edited texts against brute force."""

import hashlib
import random

import numpy as np
import pytest

from netquill.llm import fingerprints, queries
from netquill.llm.fingerprints import OnePermutation

SCHEMA = "doc_id bigint, text string, part int, place string, tie string, id string"


def shingles(text, n=5):
    words = text.encode().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_fingerprint(method, text):
    """Bin by bin, hop by hop."""
    hashes = [int(h) for h in method.shingles(text.encode())]
    if not hashes:
        return b""
    width = 64 - (method.bins.bit_length() - 1)
    least = {}
    for h in hashes:
        least[h >> width] = min(h, least.get(h >> width, h))
    values = []
    for b in range(method.bins):
        at = b if b in least else next(int(x) for x in method.paths[b] if int(x) in least)
        values.append(int(fingerprints.mixed(np.array([least[at]], np.uint64) + np.uint64(b * 0x9E3779B97F4A7C15 % 2**64))[0]) % 2**method.bits)
    bits = "".join(f"{v:0{method.bits}b}" for v in values)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


@pytest.mark.parametrize(("bins", "bits"), [(8, 8), (64, 1), (64, 2), (512, 4)])
def test_fingerprint_bin_by_bin(bins, bits):
    rng, method = random.Random(1), OnePermutation(bins, bits)
    for n in (0, 1, 2, 4, 5, 6, 9, 40, 300, 3000):
        text = " ".join(f"w{rng.randrange(500)}" for _ in range(n))
        assert method.fingerprint(text.encode()) == plain_fingerprint(method, text)


def test_likeness_estimates_jaccard():
    rng, method = random.Random(2), OnePermutation()
    errors = []
    for n in (5, 8, 20, 60, 300, 2000):
        for share in (0.0, 0.1, 0.5, 0.9, 1.0):
            for _ in range(12):
                words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
                other = words[: round(n * share)] + [f"v{rng.randrange(10**6)}" for _ in range(n - round(n * share))]
                a, b = " ".join(words), " ".join(other)
                got = method.likeness(*(method.fingerprint(t.encode()) for t in (a, b)))
                errors.append(got - jaccard(a, b))
                assert 0 <= got <= 1 and abs(errors[-1]) < 0.13, (n, share)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


def test_texts_without_words():
    m = OnePermutation()
    assert m.fingerprint(b"") == m.fingerprint(b" \n\t") == b""
    assert m.likeness(b"", b"") == 1 and m.likeness(b"", m.fingerprint(b"x")) == 0
    assert sum(m.likeness(m.fingerprint(b"x"), m.fingerprint(str(i).encode())) for i in range(50)) < 2


@pytest.mark.parametrize("wrong", [(500, 4, 5), (4, 4, 5), (512, 3, 5), (512, 4, 0)])
def test_wrong_parameters(wrong):
    with pytest.raises(ValueError, match="no fingerprints"):
        OnePermutation(*wrong)


def expected(rows):
    """rows (id, text) in descending order of ids, ties in any order given."""
    method, out = OnePermutation(), []
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 3
        changed = text[: len(text) - cut] + following[:cut]
        own, second, other = (method.fingerprint(t.encode()) for t in (text, changed, following))
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.hex(), second.hex(), method.likeness(own, second), method.likeness(own, other)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r[0], r.n_chars, r.edited_sha256.hex(), r.fingerprint.hex(), r.edited_fingerprint.hex(), r.near_edited, r.near_next) for r in df.collect()), key=str)


def frame(spark, rows, parts):
    return spark.createDataFrame([(i, t, 1, "x", "y", "z") for i, t in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_edited_texts(spark, parts):
    rng = random.Random(parts)
    texts = [" ".join(rng.choice(["lorem", "ipsum", "dolor", "sît", "a", "\U0001f600"]) for _ in range(rng.choice([0, 1, 3, 4, 5, 30, 400]))) for _ in range(150)]
    texts += [texts[5], "", " \n", "é" * 10000, "x " * 700_000]
    ids = rng.sample(range(-500, 5000), len(texts))
    rows = sorted(zip(ids, texts, strict=True), reverse=True)
    assert got(fingerprints.edited_fingerprints(frame(spark, rows, parts))) == expected(rows)


def test_odd_rows(spark):
    assert fingerprints.edited_fingerprints(frame(spark, [], 2)).count() == 0
    one = [(7, "some words of a single document here")]
    assert got(fingerprints.edited_fingerprints(frame(spark, one, 2))) == expected(one)
    # Null texts are empty, rows without id come last, rows that repeat whole follow each other.
    rows = [(9, None), (9, None), (4, "a b c d e f g h i j k l"), (4, "a b c d e f g h i j k l"), (None, "the last one of them all")]
    assert got(fingerprints.edited_fingerprints(frame(spark, rows, 3))) == expected([(i, t or "") for i, t in rows])
    same = [(3, "one text for all of the rows")] * 40
    assert got(fingerprints.edited_fingerprints(frame(spark, same, 4))) == expected(same)


def test_columns_pass(spark):
    df = fingerprints.with_fingerprints(frame(spark, [(1, "a b"), (2, None)], 1), ["doc_id", "place"], name="place")
    assert df.columns == ["doc_id", "place"] and [len(r.place) for r in df.orderBy("doc_id").collect()] == [256, 0]


def test_query_against_brute_force(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    want = expected(sorted(((r.doc_id, r.text or "") for r in docs), reverse=True))
    rows = queries.op11_fingerprints(spark, path).collect()
    have = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in rows), key=str)
    assert have == want
