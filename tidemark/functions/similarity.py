"""Fuzzy string scores from 0 to 100, as Arrow UDFs that score a whole batch of pairs at a time."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Pairs that are compared in step: their codes stay in a core's cache.
LANES = 4096
WORD, LATIN = re.compile(r"\w+"), re.compile("[\x80-\xff]+")


def codes(strings: list[str], width: int) -> np.ndarray:
    """Code points, a row a string; what follows its end is cut off by ``spelled``."""
    return np.array(strings, dtype=f"<U{width}").view(np.uint32).reshape(len(strings), width)


def spelled(short: list[str], long: list[str], ns: np.ndarray, nl: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Both sides as small numbers for their characters, 0 and 1 for none on the one and on the other side."""
    width = int(nl.max())
    x, y = codes(short, n), codes(long, width)
    here = np.unique(np.concatenate([np.unique(x), np.unique(y)]))
    kind = np.uint8 if len(here) < 254 else np.uint32
    small = np.zeros(int(here[-1]) + 1, dtype=kind)
    small[here] = np.arange(2, len(here) + 2)
    return np.where(np.arange(n) < ns[:, None], small[x], kind(0)), np.ascontiguousarray(np.where(np.arange(width) < nl[:, None], small[y], kind(1)).T)


def common_of(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of strings.

    Each pair has a lane of bits, one for a character of its shorter string, in as many 64-bit words as that needs. All lanes take
    the next character of their longer strings at once: with hits H among the bits V, V becomes (V + H) | (V - H); bits that end at 0 count.
    """
    size_a, size_b = sizes(a), sizes(b)
    ns, nl, swap = np.minimum(size_a, size_b), np.maximum(size_a, size_b), size_a > size_b
    out = np.zeros(len(a), dtype=np.int64)
    # Lanes of like sizes go together.
    order = np.lexsort((nl, lanes(ns)))
    order = order[ns[order] > 0]
    starts = np.flatnonzero(np.diff(lanes(ns[order]), prepend=-1)).tolist() + [len(order)]
    for begin, end in zip(starts, starts[1:], strict=False):
        n = int(lanes(ns[order[begin]]))
        kind = np.dtype(f"u{min(8, n // 8)}")
        for at in range(begin, end, LANES):
            own = order[at : min(end, at + LANES)]
            first, last = [b[i] if swap[i] else a[i] for i in own], [a[i] if swap[i] else b[i] for i in own]
            x, y = spelled(first, last, ns[own], nl[own], n)
            v = np.full((max(1, n // 64), len(own)), ~kind.type(0))
            for c in y:
                hits = np.packbits(x == c[:, None], axis=1, bitorder="little").view(kind)
                carry: np.ndarray | int = 0
                for w in range(len(v)):
                    hit = hits[:, w] & v[w]
                    # The sum of three, with what it carries into the next word.
                    half = v[w] + hit
                    total = half + carry if w else half
                    if w + 1 < len(v):
                        carry = ((half < v[w]) | (total < half)).astype(kind)
                    v[w] = total | (v[w] ^ hit)
            out[own] = n - np.bitwise_count(v).sum(axis=0, dtype=np.int64)
    return out


def lanes(n: np.ndarray) -> np.ndarray:
    """Bits of the lane that a string of n characters takes: 8, 16, 32 or whole words of 64."""
    return np.where(n <= 8, 8, np.where(n <= 16, 16, np.where(n <= 32, 32, (n + 63) // 64 * 64)))


def scaled(common: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Twice the common length against both lengths together, of 100, half to even; 0 of nothing."""
    return np.rint(200 * common / np.maximum(size, 1)).astype(np.int32)


def sizes(strings: Iterable[str]) -> np.ndarray:
    return np.fromiter(map(len, strings), dtype=np.int64)


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Twice the common subsequence against both lengths; 0 where one is empty."""
    size_a, size_b = sizes(a), sizes(b)
    score = scaled(common_of(a, b), size_a + size_b)
    return np.where((size_a == 0) | (size_b == 0), 0, score)


def words(s: str | None) -> list[str]:
    """Lower-case words; characters from U+0080 to U+00FF are dropped first."""
    return [w.lower() for w in WORD.findall(LATIN.sub("", s or ""))]


def token_sort_ratios(a: list[str], b: list[str]) -> np.ndarray:
    named = {s: " ".join(sorted(words(s))) for s in {*a, *b}}
    return ratios([named[s] for s in a], [named[s] for s in b])


def token_set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """The best of comparing the shared words and both sides' shared words followed by their own; 0 where a side has no word.

    Shared words are a beginning of both sides, so they are common as they stand, and only what follows them is compared.
    """
    held = {s: (frozenset(own := words(s)), " ".join(sorted(set(own)))) for s in {*a, *b}}
    shared, left, right = [""] * len(a), [""] * len(a), [""] * len(a)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        (p, whole_p), (q, whole_q) = held[x], held[y]
        if p.isdisjoint(q):
            left[i], right[i] = whole_p, whole_q
        else:
            both = p & q
            shared[i] = " ".join(sorted(both))
            if len(both) < len(p):
                left[i] = " ".join(sorted(p - both))
            if len(both) < len(q):
                right[i] = " ".join(sorted(q - both))
    s, l, r = sizes(shared), sizes(left), sizes(right)  # noqa: E741
    gap = (s > 0).astype(np.int64)
    whole_l, whole_r = s + (gap + l) * (l > 0), s + (gap + r) * (r > 0)
    both_own = (l > 0) & (r > 0)
    # Before words of their own both sides have the same blank; else the shorter side is the shared words.
    ahead = np.where(both_own, s + gap, s)
    best = scaled(ahead + common_of(left, right), whole_l + whole_r)
    for whole in (whole_l, whole_r):
        best = np.where(s > 0, np.maximum(best, scaled(s, s + whole)), best)
    return np.where((whole_l == 0) | (whole_r == 0), 0, best)


def single(score: Callable[[list[str], list[str]], np.ndarray]) -> Callable[[str | None, str | None], int]:
    return lambda a, b: int(score([a or ""], [b or ""])[0])


ratio, token_set_ratio, token_sort_ratio = single(ratios), single(token_set_ratios), single(token_sort_ratios)


def udf_of(score: Callable[[list[str], list[str]], np.ndarray]):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        # Each pair once; null is empty.
        place: dict[tuple[str, str], int] = {}
        at = [place.setdefault((x or "", y or ""), len(place)) for x, y in zip(a, b, strict=True)]
        if not place:
            return pd.Series([], dtype="int32")
        return pd.Series(score([x for x, _ in place], [y for _, y in place])[at], dtype="int32")

    return F.pandas_udf(run, IntegerType())


ratio_udf, token_set_udf, token_sort_udf = udf_of(ratios), udf_of(token_set_ratios), udf_of(token_sort_ratios)
