"""Numbers about a text's form and words, for the quality classifier.

A text over a megabyte is measured in pieces; its numbers are the pieces' means, weighted by bytes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import held_out
from .words import word_hashes

NAMES = (
    "log_words", "mean_word", "long_words", "short_words", "capitals", "letters", "digits", "marks", "sentence_marks",
    "lines_per_word", "other_bytes", "end_marks", "distinct_words", "common_word", "distinct_lines", "all_capitals", "exclaim", "word_mean", "word_spread", "word_low",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


UPPER, LOWERS, DIGITS = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz"), _class("0123456789")
MARKS, STOPS, LINE = _class("#$%&*@^~<>{}[]=+/\\_|`"), _class(".,;:"), _class("\n")
HIGH = np.arange(256) >= 128
PLAIN = LOWERS | UPPER | DIGITS | HIGH


def form(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x (len(NAMES) - 3): all but the numbers about words; an empty text is all zeros."""
    rows = len(offsets) - 1
    size = np.diff(offsets)

    def share(kind: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(kind[raw], dtype=np.int64)))
        return (c[offsets[1:]] - c[offsets[:-1]]) / np.maximum(size, 1)

    starts, ends, first = K.words(raw, offsets)
    n = np.diff(first)
    of = np.repeat(np.arange(rows), n)
    m = np.maximum(n, 1)
    length = ends - starts
    mean = lambda x: np.bincount(of, x, rows) / m
    upper = np.concatenate(([0], np.cumsum(UPPER[raw], dtype=np.int64)))
    lower = np.concatenate(([0], np.cumsum(LOWERS[raw], dtype=np.int64)))
    shout = (upper[ends] - upper[starts] >= 2) & (lower[ends] == lower[starts])
    last = raw[ends - 1] if len(ends) else raw[:0]
    hashes = K.span_hashes(K.LOWER[raw], starts, ends)
    lines = np.flatnonzero(LINE[raw])
    line_ends = np.unique(np.concatenate((lines, offsets[1:])))
    line_starts = np.unique(np.concatenate((offsets[:-1], lines + 1)))
    line_starts = line_starts[line_starts < len(raw)]
    line_ends = line_ends[np.searchsorted(line_ends, line_starts)] if len(line_starts) else line_ends[:0]
    line_of = np.searchsorted(offsets, line_starts, side="right") - 1
    line_hash = K.span_hashes(raw, line_starts, line_ends)
    distinct, common, distinct_lines = np.zeros(rows), np.zeros(rows), np.zeros(rows)
    cut = np.searchsorted(line_of, np.arange(rows + 1))
    for r in range(rows):
        if n[r]:
            s = np.sort(hashes[first[r] : first[r + 1]])
            runs = np.diff(np.append(np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))), len(s)))
            distinct[r], common[r] = len(runs) / len(s), runs.max() / len(s)
            distinct_lines[r] = len(np.unique(line_hash[cut[r] : cut[r + 1]])) / max(1, cut[r + 1] - cut[r])
    out = np.stack(
        [
            np.log1p(n), np.bincount(of, length, rows) / m, mean(length >= 12), mean(length <= 3), share(UPPER), share(LOWERS), share(DIGITS), share(MARKS), share(STOPS),
            np.minimum(share(LINE) * size / m, 1.0), share(HIGH), mean(~PLAIN[last]), distinct, common, distinct_lines, mean(shout), share(_class("!?")),
        ],
        axis=1,
    )
    out[n == 0] = 0.0
    return out


TABLE_BITS = 17  #: Words are hashed to 2**TABLE_BITS places.
LOW = -1.0


def fold(text: bytes) -> int:
    """Which half a text belongs to; of the text alone."""
    return zlib.crc32(text) & 1


def places(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def word_numbers(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean and spread of the words' weights in the other half's table (2 x places), and the share of low ones."""
    rows = len(offsets) - 1
    h, row = word_hashes(raw, offsets)
    half = np.array([fold(raw[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])], dtype=np.int64)
    w = table[1 - half[row], places(h)] if len(h) else np.zeros(0)
    n = np.maximum(np.bincount(row, minlength=rows), 1)
    mean = np.bincount(row, w, rows) / n
    return np.stack([mean, np.sqrt(np.maximum(np.bincount(row, w * w, rows) / n - mean**2, 0)), np.bincount(row, w < LOW, rows) / n], axis=1)


def measured(texts, table: np.ndarray):
    """Row ranges of a string column and their numbers."""
    raw, off = K.column_bytes(texts)
    for i, j in K.chunks(off):
        got = [(len(part), np.concatenate((form(part, at), word_numbers(part, at, table)), axis=1)) for part, at, _ in K.pieces(raw, off[i : j + 1], K.IS_SEP)]
        yield i, j, got[0][1] if len(got) == 1 else np.average([x for _, x in got], axis=0, weights=[n for n, _ in got])


def features(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """doc_id, held_out, pos (as docs has it) and x (the numbers of NAMES) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            for i, j, x in measured(batch.column(3), held.value):
                at = pa.array(np.arange(0, (j - i + 1) * x.shape[1], x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(3)), pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(x).reshape(-1)))], ["doc_id", "held_out", "pos", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "pos", "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, pos boolean, x array<double>")
