"""Vectorised byte and word kernels shared by the Arrow-based operators of this subpackage.

All functions work on one concatenated buffer of a bounded batch of documents. Polynomial prefix sums modulo 2**64
give the hash of any substring in constant time; `mix` spreads the bits afterwards.
"""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        step = np.full(size, base, dtype=np.uint64)
        step[0] = 1
        have = _powers[base] = np.multiply.accumulate(step)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(data: np.ndarray, salt: int = 1) -> np.ndarray:
    """Prefix sums of (byte + salt) * BASE**i; entry i covers data[:i]."""
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(salt)) * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of the substrings [start, end); the same bytes hash alike at every place."""
    return mix((prefix[end] - prefix[start]) * powers(BASE_INVERSE, len(prefix))[start])


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def join_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts as UTF-8, each followed by a newline, and the offsets of the texts (n + 1 entries)."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=offsets[1:])
    return np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8), offsets


def runs(column, size: int):
    """Slices (start, stop) of an Arrow text column of about `size` characters each, one text at least."""
    import pyarrow.compute as pc

    total = np.cumsum(np.asarray(pc.fill_null(pc.utf8_length(column), 0), dtype=np.int64))
    begin = 0
    while begin < len(column):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + size)))
        yield begin, end
        begin = end


CHUNK = 1 << 19


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of all white-space separated words, A-Z folded, and the index of each text's first word.

    Works through the buffer in chunks that end at white space, so that tables and temporaries stay small."""
    found, begin, n = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))], 0, len(data)
    while begin < n:
        end = min(n, begin + CHUNK)
        if end < n:
            tail = np.flatnonzero(_SPACE[data[begin:end]])
            end = begin + int(tail[-1]) + 1 if len(tail) else begin + int(np.flatnonzero(_SPACE[data[begin:]])[0]) + 1
        part = data[begin:end]
        inside = np.zeros(len(part) + 1, dtype=bool)
        np.logical_not(_SPACE[part], out=inside[1:])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2], edges[1::2]
        found.append((span_hash(prefix_hash(_LOWER[part]), starts, ends), starts + begin, ends + begin))
        begin = end
    hashes, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def window_extreme(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Minimum or maximum of each run of `width` consecutive values (len - width + 1 entries)."""
    n = len(values)
    if n < width:
        return values[:0]
    fill = np.full((-n) % width, values[-1], dtype=values.dtype)
    blocks = np.concatenate([values, fill]).reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - width + 1], ahead[width - 1 : n])
