"""The merge index's memory by the peak of its own process, whatever the tests before held."""

import subprocess
import sys
from pathlib import Path

from test_digest_index import SCRIPT

from netquill.llm import exact_dedup

# ru_maxrss starts from the peak of the process that forked; VmHWM starts anew with the program.
OWN = SCRIPT + "\nprint(next(int(x.split()[1]) for x in open('/proc/self/status') if x.startswith('VmHWM')) // 1024)\n"


def test_a_million_short_texts_after_large_tests():
    held = bytearray(b"x") * (400 << 20)
    said = subprocess.run([sys.executable, "-c", OWN, str(Path(exact_dedup.__file__).parents[2])], capture_output=True, text=True, timeout=300)
    assert not said.returncode and len(held), said.stderr
    n, *_, peak = said.stdout.split()
    print("own peak", peak, "ru_maxrss", said.stdout.split()[2])
    assert int(n) == 1_000_000 and int(peak) < 300
