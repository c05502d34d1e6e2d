"""Similarities of titles, 0 to 100, as Arrow-batched functions.

``ratio`` is the indel similarity 2 x LCS / (sum of lengths), with a bit-parallel LCS. The partial ratio takes
the best window of the longer text, at the offsets where blocks of the shorter one match.
"""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one big-integer step per character of ``b``."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> int:
    n = len(a) + len(b)
    return 100 if not n else round(200 * lcs(a, b) / n)


def partial_ratio(a: str, b: str) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0 if b else 100
    if a in b:
        return 100
    starts = {max(0, m.b - m.a) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()}
    return max(ratio(a, b[s : s + len(a)]) for s in starts)


def token_sort_ratio(a: str, b: str) -> int:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> int:
    x, y = set(a.split()), set(b.split())
    both, only_a, only_b = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    first, second = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    best = ratio(first, second)
    return max(best, ratio(both, first), ratio(both, second)) if both else best


def similarity(a: str, b: str) -> int:
    """100 for equal texts, else the best of the four; 100 from any of them counts as exact."""
    return 100 if a == b else max(ratio(a, b), partial_ratio(a, b), token_sort_ratio(a, b), token_set_ratio(a, b))


def _pairwise(f, kind: str = "int"):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], int] = {}
        out = []
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append(None)
                continue
            if (v := known.get((x, y))) is None:
                v = known[x, y] = f(x, y)
            out.append(v)
        return pd.Series(out, dtype="Int32")

    return run


def ratio_udf(a: Column, b: Column) -> Column:
    return _pairwise(ratio)(a, b)


def partial_ratio_udf(a: Column, b: Column) -> Column:
    return _pairwise(partial_ratio)(a, b)


def token_sort_ratio_udf(a: Column, b: Column) -> Column:
    return _pairwise(token_sort_ratio)(a, b)


def token_set_ratio_udf(a: Column, b: Column) -> Column:
    return _pairwise(token_set_ratio)(a, b)


def similarity_udf(a: Column, b: Column) -> Column:
    return _pairwise(similarity)(a, b)


def transliterate(c: Column) -> Column:
    """ASCII form: accents fall away; a few letters have no decomposition and are named."""
    named = str.maketrans({"ß": "ss", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "þ": "th", "ð": "d", "ı": "i"})

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x.translate(named)).encode("ascii", "ignore").decode())

    return run(c)


def nfc(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return run(c)
