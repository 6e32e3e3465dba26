"""The merge index of op6: levels, byte verification, memory and time."""

import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from netquill.llm import exact_dedup
from netquill.llm.exact_dedup import DigestIndex


@pytest.mark.parametrize("bits", [64, 12, 3])
def test_against_a_dict(bits):
    rng, index, want = random.Random(bits), DigestIndex(), {}
    for i in range(40_000):
        text = b"t%d" % (rng.randrange(9) if rng.random() < 0.3 else rng.randrange(3000 if bits > 3 else 60))
        digest = (int.from_bytes(text, "little") * 0x9E3779B97F4A7C15 >> 3) % 2**bits - 2 ** (bits - 1)
        identifier = (-rng.randrange(3), rng.random() < 0.1, rng.randrange(50), i)
        index.add_all([[digest, text, identifier, 1 + i % 2, i]]) if i % 5 else index.add(digest, text, identifier, 1 + i % 2, i)
        least, n = want.get(text, ((identifier, i), 0))
        want[text] = min(least, (identifier, i)), n + 1 + i % 2
    got = list(index.entries())
    assert {e[1]: ((e[2], e[4]), e[3]) for e in got} == want and len(got) == len(want)
    assert [e[0] for e in got] == sorted(e[0] for e in got)
    assert index.bytes == sum(map(len, want))


def test_levels():
    index = DigestIndex()
    for i in range(0, 400_000, 4096):
        index.add_all([[j, b"%d" % j, (0, False, j, j), 1, None] for j in range(i, i + 4096)])
        assert all(len(level) < exact_dedup.MOST_RUNS for level in index.levels)
    sizes = [[len(r.entries) for r in level] for level in index.levels]
    assert len(sizes) == 4 and all(n == 4096 * exact_dedup.MOST_RUNS**k for k, level in enumerate(sizes) for n in level)


def test_filter_and_search():
    keys = np.sort(np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000))
    rows = np.zeros(5000, exact_dedup.COLUMNS)
    rows["key"], rows["text"] = keys, np.arange(5000)
    run = exact_dedup.Run(rows, np.empty(5000, object))
    others = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 20_000)
    which, at = run.find(np.concatenate([others, keys]))
    assert (which - 20_000).tolist() == at.tolist() == list(range(5000))
    passed = np.ones(20_000, bool)
    for place in run.places(others):
        passed &= run.filter[place >> np.uint64(3)] & run.bit(place) != 0
    assert passed.mean() < 0.03


SCRIPT = """
import hashlib, resource, sys, time
sys.path.insert(0, sys.argv[1])
from netquill.llm import exact_dedup as x
import zstandard
index, out, took, pack = x.DigestIndex(x.same_text()), 0, [], zstandard.ZstdCompressor(level=1)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for part in range(250):
    rows = []
    for i in range(part * 4000, part * 4000 + 4000):
        sha = hashlib.sha256(b"short %d" % i).digest()
        rows.append([int.from_bytes(sha[:8], "big") - (1 << 63), pack.compress(b"short %d" % i), (-7, False, i, i), 1, sha])
    start = time.process_time()
    index.add_all(rows)
    if index.bytes > x.MOST_BYTES or index.rows > x.MOST_ROWS:
        out += sum(1 for _ in index.entries())
        index.clear()
    took.append(time.process_time() - start)
out += sum(1 for _ in index.entries())
print(out, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024, sum(took[:125]), sum(took[125:]))
"""


def test_a_million_short_texts():
    """Memory stays bounded, and the second half takes no longer than the first."""
    said = subprocess.run([sys.executable, "-c", SCRIPT, str(Path(exact_dedup.__file__).parents[2])], capture_output=True, text=True, timeout=300)
    assert not said.returncode, said.stderr
    n, grown, whole, first, second = said.stdout.split()
    assert int(n) == 1_000_000 and int(whole) < 300, (grown, whole)
    assert float(second) < 1.6 * float(first) + 1, (first, second)
