"""Removal of word sequences that an earlier document has, by suffix automata of reference shards.

A word goes if a window of WINDOW words that covers it also starts in a document of smaller id. Documents are
streamed through a suffix automaton of the text of earlier ones: after each word its state gives the longest
match that ends there, and a match of WINDOW words or more is a span to remove.

The reference is the corpus itself, so automata of all of it can be neither broadcast within a bound nor met by every
document. It is dealt in shards, and a document meets only shards that can hold its windows. Every window has an
anchor, the run of ANCHOR words of least hash in it, which depends on the window's words alone; the piece of an
anchor is the words of all windows whose anchor it is. A shard is the pieces of one anchor, in one task; its pieces are
streamed in order of their documents through the automaton of those before. Anchors that only one document has
are found first, from hashes alone; only pieces of the others are fetched from the texts.

An anchor that holds more than one in SHARE * partitions of all anchors would make a shard that grows with the corpus.
These anchors, SHARE * partitions at most, are counted in a pass of their own and broadcast. Their windows are dealt one by one, by the
hash of all their words, so windows around a common passage that differ part, and equal ones are few for each task: of
equal pieces among HELD_PIECES the first document's is sent, and the others go whole at once.

Defined results: null text has no words; texts under WINDOW words keep all; a row with a null doc_id is compared
with nothing and keeps all; rows that repeat an id are the same document and take nothing from each other, and where
their texts differ, each loses the words at all places that one of them loses; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import documents, parts, prepare, written
from .suffix_dedup import ANCHORS, ASKED, BLOBS, PIECES, RANGES, RANGE_KINDS, TOP, dealt, home_of, merged, pack, slide, unpack
from .words import split

WINDOW, ANCHOR = 13, 7
SPREAD = 8  #: Buckets of anchors for each shuffle partition.
SHARE = 16  #: Anchors over one in SHARE * partitions of all are dealt by window.
LEAST_HOT = 64  #: An anchor of fewer occurrences never is.
HELD = 1 << 20  #: Numbers that are gathered before they are sent on.
WORDS = 1 << 16  #: Words that are Python objects at once.
HELD_PIECES = 1 << 17  #: Pieces among which a task finds equal ones before they are sent.
ANCHOR_KINDS, ASKED_KINDS, PIECE_KINDS = (np.uint32, np.int64, np.uint32), (np.int64, np.uint32), (np.uint32, np.int64, np.uint32, np.uint32)


class Automaton:
    """A suffix automaton of several sequences of words."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def _state(self, length: int, follow: dict, link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The state of the strings of q that end at p's successor; q itself where that is all of them."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def add(self, words: list) -> None:
        last = 0
        for word in words:
            if word in self.next[last]:  # another sequence has been here
                last = self._split(last, word, self.next[last][word])
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, word, self.next[p][word])
            last = new

    def matches(self, words: list, least: int):
        """(start, end) of maximal matches of at least so many words, which may overlap."""
        state = size = 0
        for i, word in enumerate(words):
            before = state, size
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            found = word in self.next[state]
            if before[1] >= least and (not found or size < before[1]):
                yield i - before[1], i
            if found:
                state, size = self.next[state][word], size + 1
        if size >= least:
            yield len(words) - size, len(words)


def repeats(pieces: list[tuple[int, int, bytes]], least: int):
    """(doc, lo, hi) of matches with pieces (doc, start, words) of smaller documents; pieces come by document, then start."""
    shard, kept, waiting, at = Automaton(), set(), [], 0
    while at < len(pieces):
        doc, fresh = pieces[at][0], []
        while at < len(pieces) and pieces[at][0] == doc:
            _, start, text = pieces[at]
            at += 1
            if text in kept:  # a reference itself: it matches whole
                yield doc, start, start + text.count(b" ") + 1
                continue
            fresh.append(text)
            if kept:
                for ref in waiting:
                    shard.add(ref.split(b" "))
                waiting = []
                for lo, hi in shard.matches(text.split(b" "), least):
                    yield doc, start + lo, start + hi
        fresh = list(dict.fromkeys(fresh))
        kept.update(fresh)
        waiting += fresh


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words in a row."""
    p, q = K.powers(len(h) + 1)
    pre = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[: len(h)], out=pre[1:])
    return K.mix((pre[n:] - pre[:-n]) * q[: len(h) - n + 1])


def minima(h: np.ndarray, first: np.ndarray, window: int, k: int):
    """Hashes of all k words in a row, and each window's least one; 0 where a window leaves its text."""
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    ends = np.repeat(first[1:], np.diff(first))
    g = np.maximum(grams(h, k), np.uint64(1))
    at = np.arange(len(g))
    g[at + k > ends[: len(g)]] = TOP
    low = slide(g, window - k + 1, np.minimum)
    low[at[: len(low)] + window > ends[: len(low)]] = 0
    return g, low


def anchors(g: np.ndarray, low: np.ndarray, window: int, k: int) -> np.ndarray:
    """Places of the anchors of all windows."""
    if not len(low):
        return np.zeros(0, np.int64)
    pad = np.zeros(window - k, np.uint64)
    return np.flatnonzero((slide(np.concatenate((pad, low, pad)), window - k + 1, np.maximum) == g) & (g != TOP))


def of_texts(column):
    """(first row, raw, offsets, starts, ends, first, hashes) of blocks of a string column."""
    raw, off = K.column_bytes(column)
    for i, j in K.chunks(off):
        block, at = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        yield i, block, at, *split(block, at)


def common_anchors(texts: DataFrame, window: int, k: int, least: int) -> np.ndarray:
    """Anchors of more than one in SHARE * partitions of all; a task reports those that are as common in a part of its texts."""
    n = SHARE * parts(texts.sparkSession)

    def count(batches):
        held, size = [], 0

        def report():
            a, m = np.unique(np.concatenate(held), return_counts=True)
            many = m >= max(2, size // n)
            return pa.RecordBatch.from_arrays([pa.array(np.append(a[many].view(np.int64), 0)), pa.array(np.append(m[many], 0)), pa.array(np.append(m[many] * 0, size))], ["anchor", "n", "total"])

        for batch in batches:
            for _, _, _, _, _, first, h in of_texts(batch.column(0)):
                g, low = minima(h, first, window, k)
                held.append(g[anchors(g, low, window, k)])
                size += len(held[-1])
                if size >= HELD:
                    yield report()
                    held, size = [], 0
        if size:
            yield report()

    found = texts.where("doc_id is not null").select("text").mapInArrow(count, "anchor long, n long, total long").groupBy("anchor").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    found = written(found, "common-anchors")
    line = max(least, (found.agg(F.sum("total")).first()[0] or 0) // n)
    hot = [r[0] for r in found.where((F.col("n") >= line) & (F.col("n") > 0)).select("anchor").collect()]  # n at most
    return np.sort(np.array(hot, np.int64).view(np.uint64))


class Gathered:
    """Columns that are sent on, dealt to buckets, when many have come together."""

    def __init__(self, kind: int, homes: int):
        self.kind, self.homes, self.columns, self.size = kind, homes, [], 0

    def add(self, doc, *more):
        if len(doc):
            self.columns.append((doc, *more))
            self.size += len(doc)
        if self.size >= HELD:
            yield from self.flush()

    def flush(self):
        if self.size:
            cols = list(map(np.concatenate, zip(*self.columns)))
            cols = list(merged(*cols)) if self.kind == RANGES else cols
            self.columns, self.size = [], 0
            yield dealt(home_of(cols[0], self.homes), self.kind, cols)


def buckets_of(batches, kind: int):
    """(bucket, blobs) of rows that come by bucket, and (None, batch) of rows of other kinds as they are."""
    now, held = None, []
    for batch in batches:
        kinds = batch.column(1).to_numpy()
        if (kinds != kind).any():
            yield None, batch.filter(pa.array(kinds != kind))
            batch = batch.filter(pa.array(kinds == kind))
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if b != now and held:
                yield now, held
                held = []
            now = b
            held.append(blob)
    if held:
        yield now, held


def repeated_ranges(spark: SparkSession, docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, least_hot: int = LEAST_HOT) -> tuple[DataFrame, int]:
    """Blobs of ranges (doc, first word, end) to remove, dealt over homes of doc_id, and the number of homes."""
    n, reach = parts(spark), window - k
    buckets, homes = n * SPREAD, n * 2 + 1
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    hot = spark.sparkContext.broadcast(common_anchors(texts, window, k, least_hot))

    def scan(batches):
        """Anchors that are not common, by bucket."""
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids = batch.column(0).to_numpy()
            got = []
            for i, _, _, _, _, first, h in of_texts(batch.column(1)):
                g, low = minima(h, first, window, k)
                at = anchors(g, low, window, k)
                at = at[~np.isin(g[at], hot.value)]
                row = np.searchsorted(first, at, side="right") - 1
                got.append((g[at], ids[row + i], (at - first[row]).astype(np.uint32)))
            if got and len((cols := list(map(np.concatenate, zip(*got))))[0]):
                yield dealt((cols[0] % np.uint64(buckets)).astype(np.int64), ANCHORS, [(cols[0] >> np.uint64(32)).astype(np.uint32), *cols[1:]])

    def shared(batches):
        """Of anchors that two documents have, all places, by home."""
        asked = Gathered(ASKED, homes)
        for _, blobs in buckets_of(batches, ANCHORS):
            key, doc, pos = map(np.concatenate, zip(*(unpack(x, *ANCHOR_KINDS) for x in blobs)))
            order = np.lexsort((doc, key))
            key, doc, pos = key[order], doc[order], pos[order]
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            stop = np.append(start[1:], len(key))
            both = np.repeat(doc[start] != doc[stop - 1], stop - start)
            yield from asked.add(doc[both], pos[both])
        yield from asked.flush()

    found = texts.mapInArrow(scan, BLOBS).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(shared, BLOBS)
    none = F.lit(None)
    home = F.pmod(F.xxhash64("doc_id"), F.lit(homes)).cast("int")
    rows = texts.where("doc_id is not null").select(home.alias("bucket"), F.lit(1).alias("kind"), "doc_id", none.cast("binary").alias("blob"), "text")
    asked = found.select("bucket", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("doc_id"), "blob", none.cast("string").alias("text"))
    rows = asked.unionByName(rows).repartition(n, "bucket").sortWithinPartitions("kind")

    def fetch(batches):
        """Pieces of the anchors asked for and windows of common anchors, by bucket; of equal ones the first document's."""
        held, wanted, gone = [], None, Gathered(RANGES, homes)
        pieces: dict[tuple[int, bytes], tuple[int, list[int]]] = {}
        for batch in batches:
            kind = batch.column(1).to_numpy()
            held += [unpack(x, *ASKED_KINDS) for x in batch.column(3).filter(pa.array(kind == 0)).to_pylist()]
            batch = batch.filter(pa.array(kind == 1))
            if not batch.num_rows:
                continue
            if wanted is None:
                doc, pos = map(np.concatenate, zip(*held)) if held else [np.zeros(0, np.int64)] * 2
                order = np.lexsort((pos, doc))
                wanted, held = (doc[order], pos[order].astype(np.int64)), []
            ids, late = batch.column(2).to_numpy(), []
            for i, raw, _, starts, ends, first, h in of_texts(batch.column(4)):
                data, mine = raw.tobytes(), ids[i : i + len(first) - 1]
                for row, f, t, key in zip(*(x.tolist() for x in spans_of(mine, first, h, *wanted))):
                    doc, a = int(mine[row]), int(first[row])
                    piece = key, b" ".join(data[starts[f] : ends[t - 1]].split())
                    seen = pieces.get(piece)
                    if seen is None:
                        pieces[piece] = doc, [f - a]
                    elif doc == seen[0]:
                        seen[1].append(f - a)
                    elif doc > seen[0]:
                        late.append((doc, f - a, t - a))
                    else:
                        late += ((seen[0], s, s + t - f) for s in seen[1])
                        pieces[piece] = doc, [f - a]
                if len(pieces) >= HELD_PIECES:
                    yield sent(pieces)
            if late:
                yield from gone.add(*(np.array(x, kind) for x, kind in zip(zip(*late), RANGE_KINDS)))
        if pieces:
            yield sent(pieces)
        yield from gone.flush()

    def spans_of(ids, first, h, docs_, places):
        """(row, first word, end, key) of the pieces that the rows of a block are asked for, and of its windows of common anchors."""
        g, low = minima(h, first, window, k)
        if not len(low):
            return [np.zeros(0, np.int64)] * 4
        lo, many = np.searchsorted(docs_, ids), np.searchsorted(docs_, ids, side="right")
        many -= lo
        row = np.repeat(np.arange(len(ids)), many)
        at = places[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(len(row))] + first[row]
        inside = at + k <= first[row + 1]  # else of another text of this id
        row, at = row[inside], at[inside]
        around = at[:, None] + np.arange(-reach, 1)
        own = (around >= 0) & (around < len(low))
        own &= low[np.where(own, around, 0)] == g[at][:, None]  # windows whose anchor this is
        some = own.any(1)
        row, at, own = row[some], at[some], own[some]
        found = row, at - reach + own.argmax(1), at - own[:, ::-1].argmax(1) + window, g[at]
        if not len(hot.value):
            return found
        common = np.flatnonzero(np.isin(low, hot.value))
        more = np.searchsorted(first, common, side="right") - 1, common, common + window, grams(h, window)[common]
        return list(map(np.concatenate, zip(found, more)))

    def sent(pieces):
        """A row for each bucket: keys, documents, starts and lengths of pieces, and their words. Empties pieces."""
        to: dict[int, list] = {}
        for (key, text), (doc, at) in pieces.items():
            to.setdefault(key % buckets, []).extend((key >> 32, doc, s, text) for s in dict.fromkeys(at))
        pieces.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(to), pa.int32()), pa.array([PIECES] * len(to), pa.int32()), pa.array([packed(v) for v in to.values()], pa.binary())], ["bucket", "kind", "blob"])

    def packed(rows):
        key, doc, start, text = zip(*rows)
        cols = [np.array(x, kind) for x, kind in zip((key, doc, start, list(map(len, text))), PIECE_KINDS)]
        plain = len(rows).to_bytes(8, "little") + pack(*cols) + b"".join(text)
        return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)

    def match(batches):
        """Streams the pieces of each anchor, by document, through the automaton of those before."""
        gone = Gathered(RANGES, homes)
        for bucket, blobs in buckets_of(batches, PIECES):
            if bucket is None:  # ranges of copies within a batch
                yield blobs
                continue
            pieces, size = [], sum(np.dtype(x).itemsize for x in PIECE_KINDS)
            for blob in blobs:
                blob = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
                m = int.from_bytes(blob[:8], "little")
                key, doc, start, length = unpack(blob[8 : 8 + size * m], *PIECE_KINDS)
                ends = 8 + size * m + np.cumsum(length.astype(np.int64))
                pieces += zip(key.tolist(), doc.tolist(), start.tolist(), (blob[e - z : e] for e, z in zip(ends.tolist(), length.tolist())))
            pieces.sort()
            late, a = [], 0
            while a < len(pieces):
                b = a
                while b < len(pieces) and pieces[b][0] == pieces[a][0]:
                    b += 1
                if pieces[a][1] != pieces[b - 1][1]:
                    late += repeats([x[1:] for x in pieces[a:b]], window)
                a = b
            if late:
                doc, lo, hi = zip(*late)
                yield from gone.add(np.array(doc, np.int64), np.array(lo, np.uint32), np.array(hi, np.uint32))
        yield from gone.flush()

    return written(rows.mapInArrow(fetch, BLOBS).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(match, BLOBS), "ranges"), homes


KEPT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, least_hot: int = LEAST_HOT) -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed words, end exclusive) and kept (the words that stay, joined by one space) of every row."""
    prepare(spark)
    ranges, homes = repeated_ranges(spark, docs, window, k, least_hot)
    home = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64(F.col("doc_id").cast("long"))), F.lit(homes)).cast("int")
    rows = docs.select(home.alias("bucket"), F.lit(1).alias("kind"), F.col("doc_id").cast("long"), F.lit(None).cast("binary").alias("blob"), F.col("text"))
    held = ranges.select("bucket", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("doc_id"), "blob", F.lit(None).cast("string").alias("text"))
    rows = held.unionByName(rows).repartition(parts(spark), "bucket").sortWithinPartitions("kind")

    def cut(batches):
        held, spans = [], None
        for batch in batches:
            kind = batch.column(1).to_numpy()
            held += [unpack(x, *RANGE_KINDS) for x in batch.column(3).filter(pa.array(kind == 0)).to_pylist()]
            batch = batch.filter(pa.array(kind == 1))
            if not batch.num_rows:
                continue
            if spans is None:
                spans, held = merged(*map(np.concatenate, zip(*held))) if held else [np.zeros(0, np.int64)] * 3, []
            ids = batch.column(2)
            raw, off = K.column_bytes(batch.column(4))
            lo, hi = (np.searchsorted(spans[0], ids.fill_null(0).to_numpy(), side=x) for x in ("left", "right"))
            hi = np.where(ids.is_valid().to_numpy(zero_copy_only=False), hi, lo)
            count, gone, kept, lists = [], [], [], []
            for r in range(batch.num_rows):
                own = raw[off[r] : off[r + 1]]
                data = own.tobytes()
                starts, ends, _ = K.words(own, np.array([0, len(own)]))
                count.append(len(starts))
                mine = [np.minimum(spans[c][lo[r] : hi[r]].astype(np.int64), len(starts)) for c in (1, 2)]
                left, at = [], 0
                for s, e in zip([*mine[0].tolist(), len(starts)], [*mine[1].tolist(), 0]):
                    left += [b" ".join(data[starts[a] : ends[min(a + WORDS, s) - 1]].split()) for a in range(at, s, WORDS)]
                    at = e
                mine = [x[mine[0] < mine[1]] for x in mine]
                lists.append(mine)
                gone.append(int((mine[1] - mine[0]).sum()))
                kept.append(b" ".join(left))
            values = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*lists)], ["start", "end"])
            cuts = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x[0]) for x in lists)]), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([ids, pa.array(count, pa.int64()), pa.array(gone, pa.int64()), cuts, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    return rows.mapInArrow(cut, KEPT)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: All windows, as texts; for small tables.
ORACLE = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
u AS (SELECT r, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
w AS (SELECT *, CASE WHEN count(*) OVER x = 13 AND doc_id IS NOT NULL THEN string_agg(word, ' ') OVER x END AS win FROM u WINDOW x AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
f AS (SELECT win, min(doc_id) AS least FROM w WHERE win IS NOT NULL GROUP BY win),
g AS (SELECT r, i, word, coalesce(least < doc_id, false)::INT AS late FROM w LEFT JOIN f USING (win)),
c AS (SELECT r, i, word, max(late) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM g),
k AS (SELECT r, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""
