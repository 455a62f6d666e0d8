"""Periodic runs of words: a harmonic grid of (period, place) pairs, extended by prefix hashes.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of at least
max(6, 4 * q) words, that no neighbouring word extends. In a run of period p the places i with i and i + p inside
number max(6, 4 * p) - p at least, so a grid of that step has one of them: over all periods of a text of n words
these are about n * ln(n) / 3 pairs. How far the words at i and i + p agree, to the right and to the left, is
found for all pairs of a block of texts at once, by binary search on differences of prefix hashes. What is long
enough is a stretch of period p; stretches found twice, or again under a multiple of their period, are one run.
Each run's words are then compared; a text in which they differ, because hashes met by chance, is searched again
word by word.

Nothing is shuffled: a text is looked at where it is read. Memory is bounded by a block of a megabyte of texts, or by
one text where that is longer, and by PAIRS grid pairs.

Defined results: null text has no words; texts under six words have no runs; a row whose id is null is taken as it
is written; rows that repeat an id are each reported; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import documents, prepare
from .words import split

SHORTEST, REPEATS = 6, 4
PAIRS = 1 << 20  #: Grid pairs that are looked at together.
WORDS = 1 << 16  #: Words that are Python objects at once.

FOUND = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def least(p):
    """Words that a run of period p has at least."""
    return np.maximum(SHORTEST, REPEATS * p)


def agree(pre: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words from i and from j on agree, limit at most, for all pairs at once; back: words before them."""
    lo, hi = np.zeros(len(i), np.int64), limit.astype(np.int64)
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live] + 1) >> 1
        x, y = (i[live] - mid, j[live] - mid) if back else (i[live], j[live])
        same = (pre[x + mid] - pre[x]) * q[x] == (pre[y + mid] - pre[y]) * q[y]
        lo[live[same]], hi[live[~same]] = mid[same], mid[~same] - 1
        live = live[lo[live] < hi[live]]
    return lo


def grid(first: np.ndarray):
    """(start, end, period) of every text and period that can have a run."""
    n = np.diff(first)
    most = np.where(n >= SHORTEST, n // REPEATS, 0)
    text = np.repeat(np.arange(len(n)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    return first[text], first[text + 1], period


def unique_runs(s: np.ndarray, e: np.ndarray, p: np.ndarray):
    """Of stretches with equal ends the one of smallest period, by start, then period."""
    o = np.lexsort((p, e, s))
    s, e, p = s[o], e[o], p[o]
    new = np.concatenate(([True], (s[1:] != s[:-1]) | (e[1:] != e[:-1])))[: len(s)]
    s, e, p = s[new], e[new], p[new]
    o = np.lexsort((p, s))
    return s[o], e[o], p[o]


def stretches(w: np.ndarray, first: np.ndarray):
    """(start, end, period) of the runs of texts whose words hash to w; text r has words first[r] to first[r + 1]."""
    pw, q = K.powers(len(w) + 1)
    pre = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * pw[: len(w)], out=pre[1:])
    begin, end, period = grid(first)
    step = least(period) - period
    many = (end - begin - period - 1) // step + 1
    upto = np.cumsum(many)
    found, a = [], 0
    while a < len(many):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, side="right")))
        row = np.repeat(np.arange(a, b), many[a:b])
        place = np.arange(len(row)) - np.repeat(upto[a:b] - many[a:b] - (upto[a] - many[a]), many[a:b])
        i = begin[row] + place * step[row]
        hit = np.flatnonzero(w[i] == w[i + period[row]])
        i, row = i[hit], row[hit]
        p = period[row]
        s = i - agree(pre, q, i, i + p, i - begin[row], back=True)
        e = i + p + agree(pre, q, i, i + p, end[row] - i - p)
        long = e - s >= least(p)
        found.append(unique_runs(s[long], e[long], p[long]))
        a = b
    return unique_runs(*map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.int64),) * 3


def word_by_word(words: list[bytes]):
    """stretches() of one text by comparing its words at every period."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    w = np.array([ids[x] for x in words], np.int64)
    found = [(np.zeros(0, np.int64),) * 3]
    for p in range(1, len(w) // REPEATS + 1):
        edge = np.diff(np.concatenate(([0], w[p:] == w[:-p], [0])).astype(np.int8))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + p
        long = e - s >= least(p)
        found.append((s[long], e[long], np.full(int(long.sum()), p)))
    return unique_runs(*map(np.concatenate, zip(*found)))


def rewritten(ids: list, first: np.ndarray) -> np.ndarray:
    """Which word stands at each place where texts are given runs by their ids' crc32, else the place itself.

    With h the crc32 of the decimal id and g = h // 10: where h % 10 is 0, words from a = g % n on repeat with
    period 1 + (n - a) // (3 + g % 8).
    """
    source = np.arange(int(first[-1]))
    for r, i in enumerate(ids):
        n = int(first[r + 1] - first[r])
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if n and h % 10 == 0:
            g = h // 10
            a = g % n
            source[first[r] + a : first[r + 1]] = first[r] + a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return source


def runs_of(docs: DataFrame, rewrite: Callable | None = None) -> DataFrame:
    """doc_id, runs (start, length, period by start, then period) and collapsed of every row of docs (doc_id, text).

    collapsed holds the words that no run contains after its first period, joined by one space. rewrite, if given,
    tells by ids and first words which word of the block stands at each place.
    """

    def search(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw, off = K.column_bytes(batch.column(1))
            for i, j in K.chunks(off):
                yield block(ids[i:j], raw[off[i] : off[j]], off[i : j + 1] - off[i])

    def block(ids, raw, off):
        starts, ends, first, hashes = split(raw, off)
        source = rewrite(ids, first) if rewrite else np.arange(len(starts))
        data = raw.tobytes()

        def words(a, b):
            return [data[x:y] for x, y in zip(starts[source[a:b]].tolist(), ends[source[a:b]].tolist())]

        def verified(s, e, p):
            return all(words(a, min(a + WORDS, e - p)) == words(a + p, min(a + WORDS, e - p) + p) for a in range(s, e - p, WORDS))

        s, e, p = stretches(hashes[source], first)
        cut = np.searchsorted(s, first)
        sizes, rows, texts = [], [], []
        for r in range(len(ids)):
            a, b = int(first[r]), int(first[r + 1])
            mine = [x[cut[r] : cut[r + 1]] for x in (s, e, p)]
            if not all(map(verified, *map(np.ndarray.tolist, mine))):
                mine = [x + y for x, y in zip(word_by_word(words(a, b)), (a, a, 0))]
            lo, hi, q = mine
            sizes.append(len(lo))
            rows.append((lo - a, hi - lo, q))
            if not len(lo) and (source[a:b] == np.arange(a, b)).all():
                texts.append(b" ".join(data[off[r] : off[r + 1]].split()))
                continue
            change = np.zeros(b - a + 1, np.int64)
            np.add.at(change, lo + q - a, 1)
            np.add.at(change, hi - a, -1)
            kept = np.flatnonzero(np.cumsum(change)[:-1] == 0) + a
            at = source[kept]
            blocks = (zip(starts[at[x : x + WORDS]].tolist(), ends[at[x : x + WORDS]].tolist()) for x in range(0, len(at), WORDS))
            texts.append(b" ".join(b" ".join(data[x:y] for x, y in z) for z in blocks))
        values = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*rows)]
        runs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.StructArray.from_arrays(values, ["start", "length", "period"]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), runs, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(search, FOUND)


def digest(found: DataFrame) -> DataFrame:
    """Counts, the longest run (ties: smallest start, then period) and digests of what runs_of() gave."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(runs_of(documents(spark, sf_dir), rewritten))


#: Pairs of equal words up to a quarter of a text apart, joined to stretches; for small tables.
ORACLE = r"""WITH tab AS (SELECT list(list_reduce(range(8)::BIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT) ORDER BY b) AS t FROM range(256) r(b)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, string_split(doc_id::VARCHAR, '') AS digits FROM documents),
h AS (SELECT r, doc_id, words, len(words) AS n, xor(list_reduce([ascii(c)::BIGINT for c in digits], lambda x, b: xor(t[xor(x & 255, b) + 1], x >> 8), 4294967295::BIGINT), 4294967295) AS h FROM d, tab),
g AS (SELECT *, coalesce(h % 10 = 0 AND n > 0, false) AS given, h // 10 AS g FROM h),
a AS (SELECT *, g % greatest(n, 1) AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
w AS (SELECT r, n, i, words[1 + CASE WHEN given AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM p)),
e AS (SELECT x.r, x.i, y.i - x.i AS period FROM w x JOIN w y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
k AS (SELECT r, period, i, i - row_number() OVER (PARTITION BY r, period ORDER BY i) AS island FROM e),
s AS (SELECT r, period, min(i) AS start, count(*) + period AS length FROM k GROUP BY r, period, island HAVING count(*) + period >= greatest(6, 4 * period)),
f AS (SELECT r, start, length, min(period) AS period FROM s GROUP BY ALL),
o AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines, arg_min([start, length, period], [-length, start, period]) AS best FROM f GROUP BY r),
c AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM w WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.r = w.r AND w.i >= f.start + f.period AND w.i < f.start + f.length) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[1]::BIGINT AS start, best[2]::BIGINT AS length, best[3]::BIGINT AS period, (1000 * best[2] // best[3])::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN o USING (r) LEFT JOIN c USING (r)"""
