"""Vectorised word and shingle hashing over Arrow string columns.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z read as a-z;
UTF-8 never uses these bytes inside a longer character, so bytes suffice.  A
word's hash is a polynomial of its bytes modulo 2**64, finalised; a shingle's
hash mixes five word hashes by position.  All are fixed by SEED alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SEED = 20240229
WIDTH = 5
BLOCK = 1 << 20
LONG_WORD = 64
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


_rng = np.random.default_rng(SEED)
_BASE = int(_rng.integers(1 << 62, 1 << 63)) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]
_STEP = _rng.integers(1, 1 << 63, 64, dtype=_U) * _U(2) + _U(1)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_tables: dict[str, np.ndarray] = {}


def _table(kind: str, n: int) -> np.ndarray:
    """Powers of the base or of its inverse; blocks above the usual size get their own."""
    if n > BLOCK:
        return _powers(_BASE if kind == "up" else _INVERSE, n)
    if kind not in _tables:
        _tables[kind] = _powers(_BASE if kind == "up" else _INVERSE, BLOCK)
    return _tables[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def word_spans(buf: np.ndarray, firsts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; firsts: where documents begin, which words never cross."""
    is_word = _IS_WORD[buf]
    start, end = is_word.copy(), is_word.copy()
    start[1:] &= ~is_word[:-1]
    end[:-1] &= ~is_word[1:]
    if firsts is not None and len(firsts):
        inner = firsts[(firsts > 0) & (firsts < len(buf))]
        start[inner] = is_word[inner]
        end[inner - 1] = is_word[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span."""
    if not len(starts):
        return np.zeros(0, dtype=_U)
    total = np.zeros(len(buf) + 1, dtype=_U)
    np.cumsum(_BYTE[buf] * _table("up", len(buf)), out=total[1:])
    sizes = ends - starts
    out = mix((total[ends] - total[starts]) * _table("down", len(buf))[starts] + sizes.astype(_U) * _STEP[63])
    for i in np.flatnonzero(sizes > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes().lower(), seed=SEED)
    return out


def text_blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, their bytes, offsets in these bytes); nulls are empty texts.

    Rows are grouped up to ``limit`` bytes; a longer text stands alone.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _cuts(buf: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of one long text, cut between words."""
    at = 0
    while at < len(buf):
        to = min(len(buf), at + BLOCK)
        while to < len(buf) and _IS_WORD[buf[to - 1]] and _IS_WORD[buf[to]]:
            gap = np.flatnonzero(~_IS_WORD[buf[to : to + BLOCK]])
            to = to + int(gap[0]) if len(gap) else min(len(buf), to + BLOCK)
        yield buf[at:to]
        at = to


def _long_words(buf: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, block by block, so that memory follows its words."""
    out = [span_hashes(part, *word_spans(part)) for part in _cuts(buf)]
    return np.concatenate(out) if out else np.zeros(0, dtype=_U)


def word_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, and of each word its start, end, hash and row), block by block.

    A long text comes in several blocks.
    """
    for lo, hi, buf, offsets in text_blocks(column):
        if hi - lo == 1 and len(buf) > BLOCK:
            for part in _cuts(buf):
                starts, ends = word_spans(part)
                yield lo, hi, part, starts, ends, span_hashes(part, starts, ends), np.full(len(starts), lo)
            continue
        starts, ends = word_spans(buf, offsets[:-1])
        counts = np.diff(np.searchsorted(starts, offsets))
        yield lo, hi, buf, starts, ends, span_hashes(buf, starts, ends), np.repeat(np.arange(lo, hi), counts)


def _windows(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    total = words[:n] * _STEP[0]
    for j in range(1, width):
        total += words[j : j + n] * _STEP[j]
    return mix(total)


def _short(words: np.ndarray, width: int) -> np.ndarray:
    """The whole sequence as one shingle, if there are words at all."""
    if not len(words):
        return np.zeros(0, dtype=_U)
    total = _U(len(words)) * _STEP[40 + width % 20]
    for j, w in enumerate(words):
        total = total + w * _STEP[j]
    return mix(np.array([total], dtype=_U))


def shingles(column: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its word shingles, repeats included) for every row of a string column.

    A text of fewer than ``width`` words gives its whole sequence as one shingle; one without words gives none.
    """
    with np.errstate(over="ignore"):
        for lo, hi, buf, offsets in text_blocks(column):
            if hi - lo == 1 and len(buf) > BLOCK:
                words = _long_words(buf)
                yield lo, _windows(words, width) if len(words) >= width else _short(words, width)
                continue
            starts, ends = word_spans(buf, offsets[:-1])
            hashes = span_hashes(buf, starts, ends)
            bounds = np.searchsorted(starts, offsets)
            every = _windows(hashes, width)
            for i in range(hi - lo):
                a, b = int(bounds[i]), int(bounds[i + 1])
                yield lo + i, every[a : b - width + 1] if b - a >= width else _short(hashes[a:b], width)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    out = np.sort(values)
    if len(out) > 1:
        keep = np.ones(len(out), dtype=bool)
        np.not_equal(out[1:], out[:-1], out=keep[1:])
        out = out[keep]
    return out
