"""Classic packet-filter programs run over frames in Arrow batches.

A program is a list of (code, jt, jf, k). By default instructions mean what the classic
machine defines. With compat, an unconditional jump goes on by jf instead of k, and NEG is the
one's complement, as in some interpreters.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Program = list[tuple[int, int, int, int]]
WORDS, MASK = 16, 0xFFFFFFFF
ARITHMETIC = {
    0x00: lambda a, b: a + b, 0x10: lambda a, b: a - b, 0x20: lambda a, b: a * b, 0x30: lambda a, b: a // b, 0x40: lambda a, b: a | b,
    0x50: lambda a, b: a & b, 0x60: lambda a, b: a << (b & 31), 0x70: lambda a, b: a >> (b & 31), 0xA0: lambda a, b: a ^ b,
}
TESTS = {0x10: lambda a, b: a == b, 0x20: lambda a, b: a > b, 0x30: lambda a, b: a >= b, 0x40: lambda a, b: a & b != 0}


def is_valid(program: Program) -> bool:
    """Not empty, ends in a return, and jumps stay inside."""
    if not program or program[-1][0] & 7 != 6:
        return False
    return all(code & 7 != 5 or (i + 1 + (k if code & 0xF0 == 0 else max(jt, jf)) < len(program)) for i, (code, jt, jf, k) in enumerate(program))


def run(program: Program, frame: bytes, wire_length: int | None = None, compat: bool = False) -> int:
    """Bytes to accept; 0 drops the frame. Loads outside the frame, and division by zero, drop it."""
    a = x = pc = 0
    memory = [0] * WORDS
    wire = len(frame) if wire_length is None else wire_length
    while pc < len(program):
        code, jt, jf, k = program[pc]
        pc += 1
        kind, mode, size = code & 7, code & 0xE0, {0x00: 4, 0x08: 2, 0x10: 1}.get(code & 0x18, 4)
        if kind in (0, 1):
            if mode in (0x20, 0x40):  # from the frame
                at = k + (x if mode == 0x40 else 0)
                if at + size > len(frame):
                    return 0
                value = int.from_bytes(frame[at : at + size], "big")
            elif mode == 0xA0:  # four times the low half of a byte: a header's length
                if k >= len(frame):
                    return 0
                x = (frame[k] & 15) * 4
                continue
            else:
                value = {0x00: k, 0x60: memory[k] if k < WORDS else 0, 0x80: wire}.get(mode, 0)
            a, x = (value, x) if kind == 0 else (a, value)
        elif kind in (2, 3):
            if k < WORDS:
                memory[k] = a if kind == 2 else x
        elif kind == 4:
            other, op = (x if code & 8 else k), code & 0xF0
            if op == 0x80:
                a = ~a & MASK if compat else -a & MASK
            elif op == 0x30 and not other:
                return 0
            elif op in ARITHMETIC:
                a = ARITHMETIC[op](a, other) & MASK
        elif kind == 5:
            op, other = code & 0xF0, (x if code & 8 else k)
            if op in TESTS:
                pc += jt if TESTS[op](a, other) else jf
            else:
                pc += jf if compat else k
        elif kind == 6:
            return a if code & 0x18 == 0x10 else k
        elif code & 0xF8 == 0:
            x = a
        else:
            a = x
    return 0


def accepted(program: Program, data: Column, wire_length: Column | None = None, compat: bool = False) -> Column:
    """Bytes that the program accepts of each frame."""
    if not is_valid(program):
        raise ValueError("not a valid program")

    @F.pandas_udf("bigint")
    def per_frame(frames: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([None if f is None else run(program, f, int(n), compat) for f, n in zip(frames, lengths, strict=True)], dtype="Int64")

    return per_frame(data, F.coalesce(wire_length if wire_length is not None else F.length(data), F.lit(0)))
