"""Every code point is encoded as the library encodes it, alone and among marks."""

import json
import random
import struct
import unicodedata

import pytest

from netquill.llm import bpe

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
POINTS = [c for c in [*range(0x31400), *range(0xE0000, 0xE0200)] if not 0xD800 <= c < 0xE000]


@pytest.fixture(scope="module")
def both():
    path = public.path("word_bpe_49k.json")
    return tokenizers.Tokenizer.from_file(path), bpe.Encoder(json.load(open(path)))


def differing(both, texts):
    library, own = both
    out = []
    for lo in range(0, len(texts), 5000):
        part = texts[lo : lo + 5000]
        out += [t for t, e in zip(part, library.encode_batch(part, add_special_tokens=False), strict=True) if struct.pack(f"<{len(e.ids)}I", *e.ids) != own.encode(t.encode())]
    return [[hex(ord(c)) for c in t] for t in out]


def test_every_code_point_in_a_word(both):
    assert differing(both, [f"a{chr(c)}b1{chr(c)}" for c in POINTS]) == []


def test_every_code_point_among_marks(both):
    assert differing(both, [f"\u00e1{chr(c)}\u0323\u0301x\u0327{chr(c)}" for c in POINTS]) == []


def test_decomposed_characters(both):
    texts = [t for c in POINTS if (d := unicodedata.normalize("NFD", chr(c))) != chr(c) for t in (d, f"x{d}\u0301", d[::-1])]
    assert len(texts) > 5000 and differing(both, texts) == []


def test_random_code_points(both):
    rng = random.Random(6)
    letters = [c for c in POINTS if unicodedata.category(chr(c)) != "Cn" or bpe.regex.match(r"\p{L}", chr(c))]
    marks = [c for c in POINTS if unicodedata.combining(chr(c))]
    texts = ["".join(chr(rng.choice(rng.choice([letters, marks, marks, range(33, 127)]))) for _ in range(rng.randrange(1, 12))) for _ in range(40_000)]
    assert differing(both, texts) == []
