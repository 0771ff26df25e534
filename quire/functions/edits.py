"""Edit distances and n-gram matches of a reference and a hypothesis, row by row."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import words

ORDERS = 6
SHORT = 256
#: rows whose n-grams are counted together
TOGETHER = 1000


def sequence_distance(a, b) -> int:
    """Levenshtein distance of two sequences of hashable items, a whole column of the table in a few operations on long integers."""
    low, most = 0, min(len(a), len(b))
    while low < most and a[low] == b[low]:
        low += 1
    end = 0
    while end < most - low and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[low : len(a) - end], b[low : len(b) - end]
    if not a or not b:
        return len(a) or len(b)
    at: dict = {}
    for i, x in enumerate(a):
        at.setdefault(x, []).append(i)
    size, places = len(a) // 8 + 1, {}
    for x, found in at.items():
        bits = np.zeros(8 * size, dtype=np.uint8)
        bits[found] = 1
        places[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full, last, out = (1 << len(a)) - 1, len(a) - 1, len(a)
    up, down = full, 0  # where the table grows or falls by one from row to row
    for x in b:
        same = places.get(x, 0)
        level = same | down
        side = (((same & up) + up) ^ up) | same
        rise, fall = (down | ~(side | up)) & full, up & side
        out += ((rise >> last) & 1) - ((fall >> last) & 1)
        rise, fall = (rise << 1) | 1, fall << 1
        up, down = (fall | ~(level | rise)) & full, rise & level & full
    return out


#: what is tried behind a difference, in this order: length that must agree, characters that are left out of both sides
_NEAR = ((1, 1), (1, 0), (0, 1))
_FAR = tuple(sorted(((x, y) for x in range(4) for y in range(4) if (x or y) and (x, y) not in _NEAR), key=lambda s: (max(s), s)))
STEPS = tuple((k, x, y) for k, steps in ((8, _NEAR), (4, _NEAR), (8, _FAR), (4, _FAR), (2, _NEAR + _FAR)) for x, y in steps)
#: after that, runs of some length within some reach, and how much is left out where there are none
RUNS, REACH = (8, 2, 1), 32


def gaps(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """(i, to, j, to) of what lies between common parts of two texts, in order: a way to make b of a, mostly the shortest one, found in a few steps a difference."""
    i = j = 0
    n, m = len(a), len(b)
    out = []
    while i < n and j < m:
        k = 16
        while a[i : i + k] == b[j : j + k]:
            i, j, k = i + k, j + k, 2 * k
            if i >= n and j >= m:  # equal to the end
                return out
        while k > 1:
            k >>= 1
            if a[i : i + k] == b[j : j + k]:
                i, j = i + k, j + k
        if i >= n or j >= m:
            break
        for k, x, y in STEPS:
            if a[i + x : i + x + k] == b[j + y : j + y + k] and i + x <= n and j + y <= m:
                break
        else:
            x, y = _run(a, b, i, j)
        out.append((i, i + x, j, j + y))
        i, j = i + x, j + y
    if i < n or j < m:
        out.append((min(i, n), n, min(j, m), m))
    return out


def _run(a: str, b: str, i: int, j: int) -> tuple[int, int]:
    """How far behind i and j the two go on together for one of ``RUNS``, or ``REACH``."""
    n, m = len(a), len(b)
    for k in RUNS:
        for x in range(min(REACH if k > 1 else REACH // 4, n - i - k + 1)):
            at = b.find(a[i + x : i + x + k], j, j + (2 * x + 4 * k if k < 8 else x + REACH))
            if at >= 0:
                return x, at - j
    return min(REACH, n - i), min(REACH, m - j)


@functools.lru_cache(maxsize=1 << 16)
def _between(a: str, b: str) -> int:
    return sequence_distance(a, b)


def _gap_distance(a: str, b: str) -> int:
    if len(a) < 2 or len(b) < 2:
        few, many = sorted((a, b), key=len)
        return len(many) - (len(few) == 1 and few in many)
    return _between(a, b) if len(a) + len(b) < 16 else sequence_distance(a, b)


#: gaps of so many characters, or whose sides differ by so many, and what is so near to them, are looked at once more
WIDE, UNEVEN, AROUND = 3, 2, 20


def _widened(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Gaps in which a step may have been wrong, joined with those near them."""
    out: list[tuple[int, int, int, int]] = []
    last = False
    for i, to, j, end in found:
        odd = max(to - i, end - j) > WIDE or abs(to - i - end + j) >= UNEVEN
        if out and (odd or last) and i - out[-1][1] < AROUND:
            i, j = out[-1][0], out[-1][2]
            out.pop()
            odd = True
        out.append((i, to, j, end))
        last = odd
    return out


def _edits(a: str, b: str, found: list[tuple[int, int, int, int]]) -> int:
    return sum([1 if to - i == end - j == 1 else _gap_distance(a[i:to], b[j:end]) for i, to, j, end in found])


def bounded_distance(a: str, b: str) -> tuple[int, int]:
    """Bounds of the Levenshtein distance: characters that one text has more of than the other, whatever their order, and the edits of ``gaps``."""
    found = gaps(a, b)
    upper = _edits(a, b, found)
    if upper <= 1:
        return upper, upper
    ra, rb = "".join([a[i:to] for i, to, _, _ in found]), "".join([b[j:end] for _, _, j, end in found])
    lower = max(len(ra), len(rb)) - sum(min(ra.count(c), rb.count(c)) for c in set(ra))
    return lower, upper if lower == upper else min(upper, _edits(a, b, _widened(found)))


def exact_distance(a: str, b: str) -> int:
    """Levenshtein distance: where the two bounds meet it is theirs, else that of ``sequence_distance``."""
    lower, upper = bounded_distance(a, b)
    return upper if lower == upper else sequence_distance(a, b)


def _short(a: str | None, b: str | None) -> int | None:
    """The distance, or None of short texts whose bounds leave it open."""
    if a is None or b is None:
        return None
    lower, upper = bounded_distance(a, b)
    return upper if lower == upper else None if max(len(a), len(b)) <= SHORT else sequence_distance(a, b)


def distance(a: Column, b: Column) -> Column:
    """Levenshtein distance: by bounds that meet; else of texts of up to ``SHORT`` characters by Spark's expression, of longer ones, where that takes the product of lengths, by long integers."""

    @F.pandas_udf("int")
    def find(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_short(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return F.coalesce(find(a, b), F.levenshtein(a, b))


def char_edits(ref: Column, hyp: Column) -> Column:
    return distance(ref, hyp)


def char_length(ref: Column) -> Column:
    """Denominator of a character error rate: an empty reference counts 1."""
    return F.greatest(F.lit(1), F.length(ref))


#: what Python takes for white space and Unicode does not
_SEPARATORS = str.maketrans({chr(c): chr(0xE000 + c) for c in range(0x1C, 0x20)})


def _recoded(a: str, b: str) -> tuple[str | list[str], str | list[str]]:
    """White-space tokens of two texts, each distinct one as one character, if there are enough of these."""
    r, h = (t.translate(_SEPARATORS).split() if any(chr(c) in t for c in range(0x1C, 0x20)) else t.split() for t in (a, b))
    known = {w: k for k, w in enumerate(dict.fromkeys(r + h))}
    if len(known) >= 0xD800:
        return r, h
    return "".join([chr(known[w]) for w in r]), "".join([chr(known[w]) for w in h])


def word_distance(a: str, b: str) -> int:
    """Levenshtein distance of the token sequences of two texts."""
    if a == b:
        return 0
    r, h = _recoded(a, b)
    return exact_distance(r, h) if isinstance(r, str) else sequence_distance(r, h)


def word_edits(ref: Column, hyp: Column) -> Column:
    """Levenshtein distance of token sequences, however many different tokens there are."""

    @F.pandas_udf("int")
    def find(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else word_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return find(ref, hyp)


def word_length(ref: Column) -> Column:
    return F.greatest(F.lit(1), F.size(words(ref)))


def _matched(texts: list[str], lengths: list[int], blocks: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in one array, each one's row, and the common part that it lies in, or -1; lengths, blocks: of runs of these."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    return points, rows, np.repeat(np.array(blocks, dtype=np.int32), lengths)


def _runs(refs: list[str], hyps: list[str]) -> tuple[list[int], list[int], list[int]]:
    """Lengths of common parts and what is between them, of all rows, on both sides; and the number of each, -1 between them."""
    left, right, blocks = [], [], []
    for a, b in zip(refs, hyps, strict=True):
        i = j = 0
        for at, to, below, end in gaps(a, b):
            left += (at - i, to - at)
            right += (below - j, end - below)
            blocks += (len(left), -1)
            i, j = to, end
        left.append(len(a) - i)
        right.append(len(b) - j)
        blocks.append(len(left))
    return left, right, blocks


def _left(points: np.ndarray, rows: np.ndarray, block: np.ndarray, orders: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n of 1 to ``orders``, sorted (row, n-gram) keys, a 64-bit hash, of the n-grams that lie in no common part, and the row of each."""
    ends = np.concatenate([block, np.full(orders - 1, -2, dtype=np.int32)])
    at = np.flatnonzero((block < 0) | (block != ends[orders - 1 :]))  # of the longest, which hold the others
    key = rows[at].astype(np.uint64) + np.uint64(1)
    for n in range(1, orders + 1):
        fits = at <= len(points) - n
        at, key = at[fits], key[fits]
        fits = rows[at] == rows[at + n - 1]
        at, key = at[fits], key[fits]
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25) + points[at + n - 1].astype(np.uint64)
        mine = (block[at] < 0) | (block[at] != block[at + n - 1])
        found = (key[mine] ^ (key[mine] >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(found, kind="stable")
        yield found[order], rows[at[mine][order]]


def _common(ka: np.ndarray, ra: np.ndarray, kb: np.ndarray, rows: int) -> np.ndarray:
    """How many keys of two sorted multisets are common, by row."""
    if not len(ka) or not len(kb):
        return np.zeros(rows, dtype=np.int64)
    first = np.flatnonzero(np.r_[True, ka[1:] != ka[:-1]])
    here = np.diff(np.r_[first, len(ka)])
    there = np.searchsorted(kb, ka[first], "right") - np.searchsorted(kb, ka[first], "left")
    return np.bincount(ra[first], weights=np.minimum(here, there), minlength=rows).astype(np.int64)


def gram_matches(refs: list[str], hyps: list[str], orders: int = ORDERS) -> np.ndarray:
    """Rows as ``gram_counts`` has them.

    An n-gram inside a common part is matched by the same one of the other text; multisets without such pairs have as many matches fewer,
    so only n-grams that a difference touches are sorted.
    """
    left, right, blocks = _runs(refs, hyps)
    out = np.zeros((len(refs), 3 * orders), dtype=np.int64)
    sizes = [np.array([len(t) for t in texts], dtype=np.int64) for texts in (refs, hyps)]
    with np.errstate(over="ignore"):
        a, b = _matched(refs, left, blocks), _matched(hyps, right, blocks)
        for n, ((ka, ra), (kb, rb)) in enumerate(zip(_left(*a, orders), _left(*b, orders), strict=True), 1):
            all_a, all_b = (np.maximum(size - n + 1, 0) for size in sizes)
            paired = all_a - np.bincount(ra, minlength=len(refs))
            out[:, 3 * n - 3], out[:, 3 * n - 2], out[:, 3 * n - 1] = paired + _common(ka, ra, kb, len(refs)), all_a, all_b
    return out


def gram_counts(ref: Column, hyp: Column, orders: int = ORDERS, spaces: bool = True) -> Column:
    """array<long>: for n of 1 to ``orders``, n-grams that match, of the reference, of the hypothesis.

    Matches are those of multisets.  Counted in the row itself: to explode every n-gram would multiply
    rows by six times their length and shuffle them.
    """

    @F.pandas_udf("array<long>")
    def count(refs: pd.Series, hyps: pd.Series) -> pd.Series:
        found = [np.zeros((0, 3 * orders), dtype=np.int64)]
        for lo in range(0, len(refs), TOGETHER):
            found.append(gram_matches(refs[lo : lo + TOGETHER].tolist(), hyps[lo : lo + TOGETHER].tolist(), orders))
        return pd.Series(list(np.concatenate(found)), dtype=object)

    bare = (lambda c: c) if spaces else (lambda c: F.regexp_replace(c, r"\s+", ""))
    return count(bare(F.coalesce(ref, F.lit(""))), bare(F.coalesce(hyp, F.lit(""))))
