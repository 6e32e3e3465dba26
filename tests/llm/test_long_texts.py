"""Texts of over a mebibyte are read whole by every operator: what stands at their very end counts."""

import json
import random
import re
from collections import Counter

import pytest
from test_operators import plain_fingerprint, table

from netquill.llm import bpe, fingerprints, language_id, mil_quality, quality_rules, simhash, toxicity

RNG = random.Random(21)
WORDS = [f"w{i}" for i in range(300)] + ["Ünï", "$x", "a|b"]
PROSE = " ".join(RNG.choice(WORDS) for _ in range(310_000))
TEXTS = [PROSE, PROSE + " #END end", "x" * 1_300_000, "line\n" * 260_000, "short text"]


@pytest.fixture(scope="module")
def docs(spark):
    assert all(len(t.encode()) > 1 << 20 for t in TEXTS[:4])
    return table(spark, TEXTS).cache()


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_rules(spark, docs):
    got = by_id(quality_rules.apply_rules(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for i, t in enumerate(TEXTS):
        words, lines = t.split(), [x for x in t.split("\n") if x.split()]
        times = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {k + j for k in range(len(words) - 4) if times[tuple(words[k : k + 5])] > 1 for j in range(5)}
        assert got[i] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)), i


def test_simhash(docs):
    got = by_id(simhash.near_groups(docs, keep=["doc_id"]), "fingerprint")
    assert {i: int(f, 16) for i, (f,) in got.items()} == {i: plain_fingerprint(t) for i, t in enumerate(TEXTS)}


def test_bpe(docs):
    public, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = public.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    got = by_id(bpe.encode_decode(docs, path, keep=["doc_id"]), "ids", "decoded")
    for i, t in enumerate(TEXTS):
        ids = library.encode(t, add_special_tokens=False).ids
        assert bytes(got[i][0]) == b"".join(x.to_bytes(4, "little") for x in ids) and got[i][1] == library.decode(ids, skip_special_tokens=False), i
    assert json.load(open(path))["model"]["type"] == "BPE"


def test_fingerprints(docs):
    method = fingerprints.OnePermutation()
    got = by_id(fingerprints.with_fingerprints(docs, ["doc_id"]), "fingerprint")
    assert {i: bytes(f) for i, (f,) in got.items()} == {i: method.fingerprint(t.encode()) for i, t in enumerate(TEXTS)}
    half = method.fingerprint(PROSE[: len(PROSE) // 2].encode())
    assert method.likeness(bytes(got[0][0]), half) == pytest.approx(0.5, abs=0.08)


def test_models(docs):
    """Scores over a table are those of the whole texts, and a text's end moves them."""
    good, bad = b"the sea walks over green hills", b"BUY $$$ now | | |"
    quality = mil_quality.train([(t * k, y) for k in range(1, 40) for t, y in ((good, 1), (bad, 0))])
    toxic = toxicity.train([(t + b" %d" % k, y) for k in range(60) for t, y in ((good, 0), (bad, 1))])
    texts = [t.encode() for t in TEXTS]
    for found, own in (
        (mil_quality.score_quality(docs, quality, ["doc_id"]), mil_quality.scores(texts, quality)),
        (toxicity.score_toxicity(docs, toxic, ["doc_id"]), toxicity.scores(texts, *toxic)),
    ):
        got = by_id(found, "score")
        assert all(got[i][0] == pytest.approx(float(s), abs=1e-6) for i, s in enumerate(own))
    ends = [b"x " * 700_000, b"x " * 700_000 + bad]
    assert toxicity.scores(ends, *toxic)[1] > toxicity.scores(ends, *toxic)[0] + 0.1
    model = language_id.train([(b"kato mira " * 9, "aa"), (b"schung verss " * 9, "bb")] * 20, 40)
    got = by_id(language_id.identify(docs, model, ["doc_id"]), "lang_pred", "score")
    names, scores = language_id.predict(texts, *model)
    assert all(got[i][0] == n and got[i][1] == pytest.approx(float(s), abs=1e-5) for i, (n, s) in enumerate(zip(names, scores, strict=True)))
    assert language_id.predict([b"kato mira " * 20_000 + b"schung verss " * 120_000], *model)[0] == ["bb"]
