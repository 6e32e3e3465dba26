"""BPE encoding and decoding with the vocabulary file of a public tokenizer.

Merges run by a priority queue of merge ranks over a doubly linked list of symbols: each
possible merge of neighbours waits in the queue, and an entry whose symbols have changed in
the meantime is stale and skipped. Decoding concatenates vocabulary strings.

The kind of file: a `tokenizers` JSON with a BPE model, an end-of-word suffix, NFC and lower
case as normaliser, a split by a pattern that leaves out white space, bytes mapped to visible
characters, and no decoder (so tokens are joined by one space).

Edge cases: null and empty texts have no tokens and decode to the empty text; a text of white
space only likewise. Texts that hold a special token's string get that token's id, as in the
library. Repeated rows each get their own result.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from array import array
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import per_text

#: Pieces between white space, and words, that a Python worker remembers; past it the memory starts anew.
REMEMBERED = 400_000
#: Longer ones are not remembered.
REMEMBERED_BYTES = 64


# Where the library's Unicode tables differ from those of Python and its regex module. Its letters and numbers are
# those of Unicode 16, its lower case is that of Unicode 17, and its normal form knows no marks and compositions that came after Unicode 9.
NEWER_LETTERS = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB\U00011DF1"
    r"\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF3\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20"
    r"\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24"
    r"\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5"
    r"\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD"
)
NEWER_NUMBERS = r"\U00011DE0-\U00011DE9\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016FF4-\U00016FF6"
NEWER_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B,
    **{c: c + 32 for c in range(0x10D50, 0x10D66)}, **{c: c + 27 for c in range(0x16EA0, 0x16EB9)},
}
NEWER_MARKS = (
    r"\u07FD\u0898-\u089F\u08CA-\u08D3\u09FE\u0C3C\u0D3B-\u0D3C\u0EBA\u1715\u1ABF-\u1ACE\u1DF6-\u1DFA\uA82C"
    r"\U00010D24-\U00010D27\U00010EAB-\U00010EAC\U00010EFD-\U00010EFF\U00010F46-\U00010F50\U00010F82-\U00010F85\U00011070\U0001133B\U0001145E\U00011839-\U0001183A"
    r"\U00011930\U0001193D-\U0001193E\U00011943\U000119E0\U00011A34\U00011A47\U00011A99\U00011D42\U00011D44-\U00011D45\U00011D97\U00011F41-\U00011F42"
    r"\U00016FF0-\U00016FF1\U0001E08F\U0001E130-\U0001E136\U0001E2AE\U0001E2EC-\U0001E2EF\U0001E4EC-\U0001E4EF"
)
OTHER_MARK = regex.compile(f"([{NEWER_MARKS}])")
NEWER = regex.compile(f"[{NEWER_LETTERS}{NEWER_NUMBERS}{NEWER_MARKS}{''.join(map(chr, NEWER_LOWER))}]")


def newer_normalised(text: str) -> str:
    """Normal form C and lower case of a text with NEWER characters. A mark that the library doesn't know stands like a letter between what is before and after it."""
    text = "".join([unicodedata.normalize("NFC", piece) for piece in OTHER_MARK.split(text)])
    return "".join([c.lower() for c in text.translate(NEWER_LOWER)])


def visible_bytes() -> list[str]:
    """The character that stands for each byte: itself where it is visible, else one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else extra))
        extra += b not in shown
    return out


def merge_word(symbols: list[int], pairs: dict[int, int]) -> list[int]:
    """Apply merges in order of rank, then from left to right.

    pairs: left << 16 | right -> rank << 16 | merged symbol. Symbols and ranks have 16 bits.
    """
    n = len(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    after[-1] = -1
    get, queue = pairs.get, []
    for i in range(n - 1):
        found = get(symbols[i] << 16 | symbols[i + 1])
        if found is not None:
            queue.append(found << 32 | i)
    heapify(queue)
    while queue:
        entry = heappop(queue)
        i = entry & 0xFFFFFFFF
        j = after[i]
        if j < 0 or symbols[i] < 0 or get(symbols[i] << 16 | symbols[j]) != entry >> 32:
            continue  # stale
        merged = symbols[i] = entry >> 32 & 0xFFFF
        symbols[j] = -1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            found = get(merged << 16 | symbols[k])
            if found is not None:
                heappush(queue, found << 32 | i)
        h = before[i]
        if h >= 0:
            found = get(symbols[h] << 16 | merged)
            if found is not None:
                heappush(queue, found << 32 | h)
    return [x for x in symbols if x >= 0]


class Remembered(dict):
    """A dict that makes what it does not have, and forgets all when full."""

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, key):
        got = self.make(key)
        if len(key) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = got
        return got


class Encoder:
    """Encodes texts given as UTF-8 bytes; decodes ids."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        if max(vocab.values()) >= 1 << 16:
            raise ValueError("ids of over 16 bits")
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault(vocab[left] << 16 | vocab[right], rank << 16 | vocab[left + right])
        suffix: str = model.get("end_of_word_suffix") or ""
        chars = visible_bytes()
        self.first_ids, self.last_ids = [vocab[c] for c in chars], [vocab[c + suffix] for c in chars]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s.encode() for s, i in [*vocab.items(), *self.special.items()]}
        self.is_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern: str = split["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        for kind, newer in ((r"\p{L}", NEWER_LETTERS), (r"\p{N}", NEWER_NUMBERS)):
            pattern = pattern.replace(kind, f"[{kind}--[{newer}]]")
        self.newer_words = regex.compile(pattern, regex.V1)
        self.chunks, self.of_word = Remembered(self.ids_of_chunk), Remembered(self.ids_of_word)

    def ids_of_word(self, word: str) -> bytes:
        symbols = [self.first_ids[b] for b in word.encode()]
        symbols[-1] = self.last_ids[word.encode()[-1]]
        ids = merge_word(symbols, self.pairs) if len(symbols) > 1 else symbols
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids_of_plain(self, text: str) -> bytes:
        if text.isascii():
            words = self.words.findall(text.lower())
        elif NEWER.search(text):
            words = self.newer_words.findall(newer_normalised(text))
        else:
            words = self.words.findall("".join([c.lower() for c in unicodedata.normalize("NFC", text)]))
        of_word = self.of_word
        return b"".join([of_word[w] for w in words])

    def ids_of_chunk(self, chunk: bytes) -> bytes:
        """Of text without ASCII white space (no token spans it), as little-endian 32-bit integers."""
        text, out, at = chunk.decode("utf-8", "replace"), [], 0
        for m in self.is_special.finditer(text) if self.is_special and any(s[0].encode() in chunk for s in self.special) else ():
            out += [self.ids_of_plain(text[at : m.start()]), struct.pack("<I", self.special[m[0]])]
            at = m.end()
        return b"".join([*out, self.ids_of_plain(text[at:])])

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole text, as little-endian 32-bit integers."""
        return b"".join(map(self.chunks.__getitem__, text.split()))

    def decode(self, ids: bytes) -> bytes:
        """The tokens' vocabulary strings, one space between; unknown ids are left out."""
        listed = array("I", ids).tolist()
        try:
            return b" ".join(map(self.strings.__getitem__, listed))
        except KeyError:
            return b" ".join([self.strings[i] for i in listed if i in self.strings])


#: The encoder of this worker process, by the content of its file.
_ready: dict[int, Encoder] = {}


def encode_decode(docs: DataFrame, tokenizer_file: str, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns in keep, with ids (binary: unsigned 32-bit integers, little-endian) and decoded (string).

    The driver reads the file once (its size is that of the vocabulary, which does not grow
    with the data) and broadcasts it. No shuffle: each text is encoded where it is read.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        content = f.read()
    sent, mark = docs.sparkSession.sparkContext.broadcast(content), hash(content)

    def make() -> Callable[[list[bytes]], list[pa.Array]]:
        if mark not in _ready:
            _ready.clear()
            _ready[mark] = Encoder(json.loads(sent.value))
        encoder = _ready[mark]

        def work(texts: list[bytes]) -> list[pa.Array]:
            ids = [encoder.encode(t) for t in texts]
            return [pa.array(ids, pa.binary()), pa.array([encoder.decode(x) for x in ids], pa.binary()).cast(pa.string())]

        return work

    return per_text(docs, "ids binary, decoded string", make, docs.columns if keep is None else keep, text_col)
