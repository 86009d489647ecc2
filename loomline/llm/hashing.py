"""Vectorised hashing of the words and word shingles in Arrow string columns.

Words are runs of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. All hashes have 64 bits. Work goes on in
pieces of about a megabyte, so memory follows the piece and the number of words, whatever the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_folded = np.arange(256)
_folded[65:91] += 32
BYTE = mix((_folded + 1).astype(_U) * _U(0x9E3779B97F4A7C15))
_STEP = _U(0xD6E8FEB86659FD93)  # odd, so it has an inverse modulo 2**64
_BACK = _U(pow(int(_STEP), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, _U)
    p[0] = 1
    return np.multiply.accumulate(p)


_up = _down = np.ones(1, _U)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each text begins in them (and the last ends). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _pieces(raw: np.ndarray, at: np.ndarray):
    """Ends of pieces: at a text's end, or at white space within a long text."""
    begin, n = 0, len(raw)
    while begin < n:
        end = min(begin + PIECE, n)
        if end < n:
            k = np.searchsorted(at, end, "right") - 1
            if at[k] > begin:
                end = int(at[k])
            else:
                limit = int(at[k + 1])
                while end < limit:
                    found = np.flatnonzero(SPACE[raw[end : min(end + PIECE, limit)]])
                    if len(found):
                        end += int(found[0])
                        break
                    end = min(end + PIECE, limit)
        yield begin, end
        begin = end


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word, and where each text's words begin among them."""
    global _up, _down
    hashes, starts, ends = [], [], []
    for begin, end in _pieces(raw, at):
        part = raw[begin:end]
        inside = ~SPACE[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = at[np.searchsorted(at, begin) : np.searchsorted(at, end)] - begin
        first[cuts] = inside[cuts]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(part) + 1 > len(_up):
            _up, _down = _powers(_STEP, len(part) + 1), _powers(_BACK, len(part) + 1)
        total = np.zeros(len(part) + 1, _U)
        np.cumsum(BYTE[part] * _up[: len(part)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * _down[s]))
        starts.append(s + begin)
        ends.append(e + begin)
    if not hashes:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, at)


_K = mix(np.arange(1, 6, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)


def shingles(word: np.ndarray, k: int = 5) -> np.ndarray:
    """A hash of every k (5 at most) words in a row; of shorter sequences, one hash of the whole."""
    if not len(word):
        return word
    n = min(k, len(word))
    h = np.zeros(len(word) - n + 1, _U)
    for j in range(n):
        h += word[j : len(word) - n + 1 + j] * _K[j]
    return mix(h + _U(n))


def groups_of(raw: np.ndarray, at: np.ndarray, most: int = 4 * PIECE):
    """Runs of texts of at most so many bytes (or one text): the first and last of them, their bytes, and offsets."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def shingle_sets(column: pa.Array, k: int = 5):
    """For each text, the sorted distinct hashes of its k-word shingles."""
    for _, _, raw, at in groups_of(*texts_of(column)):
        word, _, _, own = words(raw, at)
        for i in range(len(at) - 1):
            yield np.unique(shingles(word[own[i] : own[i + 1]], k))


def set_id(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of hashes, as two signed longs."""
    a = mix(np.array([len(hashes)], _U) + mix(hashes ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U))
    b = mix(np.array([len(hashes)], _U) + mix(hashes + _U(0x14057B7EF767814F)).sum(dtype=_U))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])
