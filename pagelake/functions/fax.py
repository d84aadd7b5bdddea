"""Line coding of ITU-T T.6 and page packing for use inside Arrow batches."""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pandas as pd

from ..fixed import (
    T4_BLACK_MAKEUP, T4_BLACK_TERMINATING, T4_SHARED_MAKEUP, T4_WHITE_MAKEUP, T4_WHITE_TERMINATING,
    T6_END_OF_BLOCK, T6_HORIZONTAL, T6_PASS, T6_VERTICAL,
)

TERMINATING = (T4_WHITE_TERMINATING, T4_BLACK_TERMINATING)
MAKEUP = (T4_WHITE_MAKEUP + T4_SHARED_MAKEUP, T4_BLACK_MAKEUP + T4_SHARED_MAKEUP)


def run_code(length: int, colour: int) -> str:
    repeats = max(0, (length - 64) // 2560)
    rest = length - repeats * 2560
    words = [MAKEUP[colour][-1]] * repeats
    if rest >= 64:
        words.append(MAKEUP[colour][rest // 64 - 1])
    words.append(TERMINATING[colour][rest % 64])
    return "".join(words)


def line_code(above, current, width: int) -> str:
    """Code bits of one line from the change positions of it and of the line above."""
    above, current = list(above), list(current)
    words: list[str] = []
    at, colour = -1, 0
    while at < width:
        k = bisect_right(current, at)
        a1 = current[k] if k < len(current) else width
        r = bisect_right(above, at)
        r += (r + colour) & 1
        b1 = above[r] if r < len(above) else width
        b2 = above[r + 1] if r + 1 < len(above) else width
        if b2 < a1:
            words.append(T6_PASS)
            at = b2
        elif (a1 - b1) in T6_VERTICAL:
            words.append(T6_VERTICAL[a1 - b1])
            at, colour = a1, 1 - colour
        else:
            a2 = current[k + 1] if k + 1 < len(current) else width
            words.append(T6_HORIZONTAL + run_code(a1 - max(at, 0), colour) + run_code(a2 - a1, 1 - colour))
            at = a2
    return "".join(words)


def line_bits(above: pd.Series, current: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([len(line_code(a.tolist(), c.tolist(), w)) for a, c, w in zip(above, current, width.tolist())], dtype="int32")


def page_stream(lines: list[str]) -> bytes:
    """Coded lines plus end mark, padded to whole bytes."""
    bits = "".join(lines) + T6_END_OF_BLOCK
    return np.packbits(np.frombuffer(bits.encode(), dtype=np.uint8) - 48).tobytes()


def deflated_length(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: len(zlib.compress(bytes(b)))).astype("int64")
