"""Runs of letters of texts, hashed."""

from __future__ import annotations

import numpy as np

from . import kernels as K
from .language_id import FOLD


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of letters; A-Z lower-cased."""
    raw = FOLD[raw]
    starts, ends, first = K.words(raw, offsets)
    return K.span_hashes(raw, starts, ends), np.repeat(np.arange(len(offsets) - 1), np.diff(first))


def text_words(texts):
    """(row, hashes) of parts of a string column; a long text comes in several parts."""
    raw, off = K.column_bytes(texts)
    for i, j in K.chunks(off):
        for part, at, of in K.pieces(raw, off[i : j + 1], FOLD == 32):
            h, row = word_hashes(part, at)
            yield i, j, h, of[row] if len(row) else row


def split(raw: np.ndarray, offsets: np.ndarray, limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word as it is written, and each row's first word; hashed about limit bytes at a time."""
    starts, ends, first = K.words(raw, offsets)
    hashes = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + limit, side="right")))
        lo = int(starts[a])
        hashes[a:b] = K.span_hashes(raw[lo : int(ends[b - 1])], starts[a:b] - lo, ends[a:b] - lo)
        a = b
    return starts, ends, first, hashes
