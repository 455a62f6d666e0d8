"""NumPy kernels over the bytes of an Arrow string column: words, shingles, rolling hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SEP = np.zeros(256, dtype=bool)
IS_SEP[list(SEPARATORS)] = True
_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
BASE = 0x9E3779B97F4A7C15
MIX1, MIX2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finalising permutation of a 64-bit hash."""
    x = x ^ (x >> U64(33))
    x *= MIX1
    x ^= x >> U64(33)
    x *= MIX2
    x ^= x >> U64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**0 .. BASE**n modulo 2**64, and their inverses."""
    if "p" not in _POWERS or len(_POWERS["p"]) <= n:
        size = 1 << max(16, int(n).bit_length())
        for key, base in (("p", BASE), ("q", pow(BASE, -1, 2**64))):
            out = np.ones(size, dtype=np.uint64)
            step, have = U64(base), 1
            while have < size:
                out[have : 2 * have] = out[:have] * step
                with np.errstate(over="ignore"):
                    step = U64(int(step) * int(step) % 2**64)
                have *= 2
            _POWERS[key] = out
    return _POWERS["p"], _POWERS["q"]


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its rows' offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = 1 << 20):
    """Row ranges of about limit bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = j


def pieces(raw: np.ndarray, offsets: np.ndarray, cut: np.ndarray, limit: int = 1 << 20):
    """(bytes, offsets, rows) of rows' texts; a single text over limit comes in several pieces, each ending after a byte of cut."""
    first, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    if len(offsets) != 2 or size <= limit:
        yield raw[first : first + size], offsets - first, np.arange(len(offsets) - 1)
        return
    s, end = first, first + size
    while s < end:
        e = min(end, s + limit)
        if e < end and len(at := np.flatnonzero(cut[raw[s + limit // 2 : e]])):
            e = s + limit // 2 + int(at[-1]) + 1
        else:  # none in reach: the next one, else all
            while e < end and not cut[raw[e - 1]]:
                e = e + 1 + int(cut[raw[e : min(end, e + limit)]].argmax()) if cut[raw[e : min(end, e + limit)]].any() else min(end, e + limit)
        yield raw[s:e], np.array([0, e - s]), np.zeros(1, np.int64)
        s = e


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and each row's first word (one entry more than rows)."""
    n = len(raw)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~IS_SEP[raw]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; it depends on the bytes alone."""
    p, q = powers(len(raw) + 1)
    pre = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[raw] * p[: len(raw)], out=pre[1:])
    return mix((pre[ends] - pre[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = 3) -> list[np.ndarray]:
    """Per row the sorted distinct 64-bit hashes of its k-word shingles, A-Z lower-cased; with fewer words, one of all."""
    if len(offsets) == 2:  # a long text is hashed in pieces that end with a separator
        h = [np.zeros(0, np.uint64)]
        for part, at, _ in pieces(raw, offsets, IS_SEP):
            part = LOWER[part]
            starts, ends, _ = words(part, at)
            h.append(span_hashes(part, starts, ends))
        h = np.concatenate(h)
        first = np.array([0, len(h)])
    else:
        raw = LOWER[raw]
        starts, ends, first = words(raw, offsets)
        h = span_hashes(raw, starts, ends)
    c = [U64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
    c += [U64(pow(int(c[0]), 2 * i + 3, 2**64) | 1) for i in range(max(0, k - 5))]
    full = np.zeros(max(0, len(h) - k + 1), dtype=np.uint64)
    for i in range(k):
        full += h[i : i + len(full)] * c[i]
    full = mix(full)
    out = []
    for r in range(len(offsets) - 1):
        a, b = int(first[r]), int(first[r + 1])
        if b - a >= k:
            s = np.sort(full[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            x = np.array([U64(b - a)], dtype=np.uint64)
            for i in range(b - a):
                x = x + h[a + i : a + i + 1] * c[i]
            out.append(mix(x ^ U64(0x5851F42D4C957F2D)))
        else:
            out.append(full[:0])
    return out
