"""Language identification with language-bitmask n-gram filters.

One Bloom filter a language would be asked once for each language; here the filters are bit-sliced: a slot
holds a bit for each of up to 64 languages, and the AND of an n-gram's slots is the mask of those that contain it;
more languages have further slots of 64.
A document's n-grams are counted by language from the masks. A filter with a share f of its slots set for a
language reports a missing n-gram with probability f**PROBES, so counts are corrected by that rate, and the
largest corrected count decides.

The filters hold every n-gram of a language's sample of labelled texts but those that are far rarer there than in
another language; they are built in Spark slot by slot, so what reaches the driver is the filters, of a size that
SLOT_BITS bounds. Beyond it slots get fuller, never fewer n-grams.

Defined results: null text or text without letters is `und` with score 0; letters of which no filter knows an
n-gram give the language with most labelled rows, score 0; without labelled rows all is `und`. Rows that repeat an
id, or have none, are judged each by its own text. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels as K
from .common import discard, documents, held_out, prepare, written

SIZES = (3, 4)
SAMPLE_ROWS = 4000  #: Labelled rows a language is learned from, at most.
LEAST_RATIO = 0.2  #: An n-gram is left out where it is rarer than this share of its frequency in another language.
LANGUAGES = 64  #: Bits of a slot; each 64 languages have slots of their own, so every language is learned.
SLOT_BITS, PROBES = 22, 3  #: A filter has 2**SLOT_BITS slots at most, else LOAD for each n-gram of the language with most.
LOAD = 12

#: Bytes of letters as they stand, A-Z lower-cased; all other ASCII is a space. Bytes past ASCII count as letters.
FOLD = np.full(256, 32, dtype=np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def grams(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams whose inner bytes are letters, and the row of each; a row is padded with spaces."""
    sizes = np.diff(offsets) + 2
    at = np.cumsum(sizes) - sizes
    text = np.full(int(sizes.sum()), 32, dtype=np.uint8)
    text[np.arange(len(raw)) + np.repeat(2 * np.arange(len(sizes)) + 1, sizes - 2)] = FOLD[raw]
    m = len(text) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    letter = text != 32
    ok = np.ones(m, dtype=bool)
    for i in range(1, n - 1):
        ok &= letter[i : i + m]
    place = np.flatnonzero(ok)
    code = np.full(len(place), n, dtype=np.uint64)
    for i in range(n):
        code = (code << np.uint64(8)) | text[place + i]
    return K.mix(code), np.searchsorted(at, place, side="right") - 1


def count_grams(sample: DataFrame) -> DataFrame:
    """(lang, gram, n) over the sample's whole texts, counted by batch and then by key."""

    def run(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            raw, off = K.column_bytes(batch.column(1))
            names = {x: i for i, x in enumerate(dict.fromkeys(langs))}
            of = np.array([names[x] for x in langs], dtype=np.int64)
            for i, j, part, at in ((i, j, p, a) for i, j in K.chunks(off) for p, a, _ in K.pieces(raw, off[i : j + 1], FOLD == 32)):
                for n in SIZES:
                    h, row = grams(part, at, n)
                    for name, number in names.items():
                        g, count = np.unique(h[of[i:j][row] == number], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(count.astype(np.int64))], ["lang", "gram", "n"])

    return sample.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def slot_bits(grams: int) -> int:
    return min(SLOT_BITS, max(12, (LOAD * max(1, grams) - 1).bit_length()))


class Filters:
    """The bit-sliced filters: names by bit, slots for each 64 languages, and the rate of false reports by language."""

    def __init__(self, names: list[str], slots: list[np.ndarray]):
        self.names, self.slots, self.false = names, slots, np.zeros(len(names))
        for i in range(len(names)):
            s = slots[i // LANGUAGES]
            self.false[i] = (np.count_nonzero(s & s.dtype.type(1 << i % LANGUAGES)) / len(s)) ** PROBES

    @staticmethod
    def kind(names: int):
        """The narrowest type with a bit for each language of a block."""
        return next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(k).itemsize * 8 >= min(LANGUAGES, max(1, names)))

    @staticmethod
    def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
        low, high = (h & np.uint64(2**32 - 1)).astype(np.int64), (h >> np.uint64(32)).astype(np.int64) | 1
        return [(low + p * high) & ((1 << bits) - 1) for p in range(PROBES)]

    def masks(self, h: np.ndarray, block: int = 0) -> np.ndarray:
        """Those of the block's languages that contain each n-gram."""
        slots = self.slots[block]
        a, *more = self.probes(h, len(slots).bit_length() - 1)
        out = slots[a]
        for s in more:
            out &= slots[s]
        return out

    def counts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of each row's n-grams each language's filter reports, and their number."""
        rows = len(offsets) - 1
        count, total = np.zeros((rows, len(self.names))), np.zeros(rows)
        for n in SIZES:
            h, row = grams(raw, offsets, n)
            total += np.bincount(row, minlength=rows)
            for first in range(0, len(self.names), LANGUAGES):
                mask = self.masks(h, first // LANGUAGES)
                for bit in range(min(LANGUAGES, len(self.names) - first)):
                    count[:, first + bit] += np.bincount(row[(mask >> mask.dtype.type(bit)) & mask.dtype.type(1) > 0], minlength=rows)
        return count, total

    def decide(self, count: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language's number and the score of each row, from counts corrected for false reports."""
        rows = len(total)
        fixed = np.maximum(0.0, (count - total[:, None] * self.false) / (1 - self.false))
        best = fixed.argmax(1)
        top = fixed[np.arange(rows), best]
        fixed[np.arange(rows), best] = -1.0
        second = np.maximum(fixed.max(1), 0.0)
        return best, np.where(top > 0, top / np.maximum(top + second, 1e-12), 0.0)


def build(names: list[str], grams_of: DataFrame) -> Filters:
    """Filters of (lang, gram) rows; a slot's bits are combined in Spark."""
    spark = grams_of.sparkSession
    most = grams_of.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    bits, kind = slot_bits(most), Filters.kind(len(names))
    number = F.broadcast(spark.createDataFrame(list(enumerate(names)), "number int, lang string"))  # a row a language
    low, high = F.col("gram").bitwiseAND(2**32 - 1), F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1))
    slot = F.explode(F.array(*[(low + p * high).bitwiseAND((1 << bits) - 1) for p in range(PROBES)]))
    rows = grams_of.join(number, "lang").select("number", slot.alias("slot"))
    rows = rows.groupBy(F.floor(F.col("number") / LANGUAGES).cast("int").alias("block"), F.col("slot").cast("int").alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, number % {LANGUAGES})")).alias("bits"))
    got = rows.toPandas()
    slots = [np.zeros(1 << bits, dtype=kind) for _ in range(-(-len(names) // LANGUAGES))]
    for block, g in got.groupby("block"):
        slots[block][g["slot"].to_numpy(np.int64)] = g["bits"].to_numpy(np.int64).view(np.uint64).astype(kind)
    return Filters(names, slots)


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Filters:
    """Filters from the text and non-null lang of documents that are not held out, about sample_rows of each language."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string"), "text")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    names = [r["lang"] for r in sizes.orderBy(F.desc("rows"), "lang").collect()]  # a row a language
    if not names:
        return Filters([], [])
    share = F.broadcast(sizes.select(F.col("lang").alias("_lang"), F.least(F.lit(1.0), F.lit(float(sample_rows)) / F.col("rows")).alias("share")))
    luck = F.pmod(F.xxhash64("doc_id", "text", F.lit(4)), F.lit(1_000_000)) / 1_000_000
    counts = written(count_grams(rows.join(share, F.col("lang") == F.col("_lang")).where(luck < F.col("share"))), "grams")
    total = F.broadcast(counts.groupBy("lang").agg(F.sum("n").alias("all")))
    counts = counts.join(total, "lang").withColumn("rate", F.col("n") / F.col("all")).withColumn("most", F.max("rate").over(W.partitionBy("gram")))
    filters = build(names, written(counts.where(F.col("rate") >= LEAST_RATIO * F.col("most")).select("lang", "gram"), "known"))
    discard(counts)
    return filters


def judged(texts: pa.Array, f: Filters):
    """Row ranges of a string column with the language's name (`und` where there is none) and score of each row."""
    raw, off = K.column_bytes(texts)
    for i, j in K.chunks(off):
        rows = j - i
        letters, other, total, count = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows), np.zeros((rows, len(f.names)))
        for part, at, of in K.pieces(raw, off[i : j + 1], FOLD == 32):
            for into, kind in ((letters, FOLD[part] != 32), (other, part >= 128)):
                x = np.concatenate(([0], np.cumsum(kind)))
                into[of] += x[at[1:]] - x[at[:-1]]
            if f.names:
                c, t = f.counts(part, at)
                count[of] += c
                total[of] += t
        best, score = f.decide(count, total) if f.names else (np.zeros(rows, int), np.zeros(rows))
        some = letters > 0
        for r in np.flatnonzero(some & (letters == other)):  # no ASCII letter: are the others letters?
            some[r] = any(c.isalpha() for c in texts[i + int(r)].as_py())
        some &= bool(f.names)
        yield i, j, [f.names[b] if s else "und" for b, s in zip(best.tolist(), some.tolist())], np.where(some, score, 0.0)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """docs' doc_id with held_out, lang_pred and score, from the text alone."""
    held = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for batch in batches:
            for i, j, names, score in judged(batch.column(2), held.value):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def spoken(docs: DataFrame, filters: Filters) -> DataFrame:
    """The rows whose own text has a language."""
    held = docs.sparkSession.sparkContext.broadcast(filters)
    text = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for i, j, names, _ in judged(batch.column(text), held.value):
                yield batch.slice(i, j - i).filter(pa.array([x != "und" for x in names], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = documents(spark, sf_dir)
    return predict(docs, learn(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose own text has a language; those without one (`und`) go. Nothing is joined, so ids may be null or repeat."""
    prepare(spark)
    return spoken(docs, learn(docs))
