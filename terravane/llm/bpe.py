"""Byte-level BPE by a pair occurrence index.

A batch's texts are cut into pre-tokens, and the distinct ones not met before are encoded together: an index
maps each pair of neighbouring symbols to all its positions, a heap holds the ranks of pairs that occur, and
ranks are applied in ascending order, each at all its positions at once. A merge replaces two symbols, so the
pairs it makes with its neighbours are added to the lists of their ranks; positions whose pair has gone are
skipped when their rank comes up. A symbol made by a merge is in no pair of a lower rank, so one ascending
sweep gives what merging each pre-token on its own would.

Defined results: null and empty text encodes to no tokens; added tokens' strings in a text become their ids; rows
that repeat an id, or have none, are encoded each by its own text; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import documents, prepare

#: Distinct pre-tokens a worker keeps with their ids; then it starts afresh, so its memory is bounded.
CACHE_WORDS = 80_000
SPACE = r"\t-\r \x85\xa0  -     　"
#: Fixed value: the pattern of byte-level pre-tokenisation, white space by its Unicode property.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
WIDE = 40  #: Positions from which a rank is applied with NumPy.


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Numbers(dict):
    """Numbers the words it is asked for; fresh has those met since it was last emptied."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        n = self[word] = len(self)
        return n


class Codec:
    """Encoder and decoder of one vocabulary file's text."""

    def __init__(self, vocabulary: str):
        import regex

        spec = json.loads(vocabulary)
        vocab, of = spec["model"]["vocab"], byte_alphabet()
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        texts = [b""] * size
        for token, i in vocab.items():
            texts[i] = bytes(of[c] for c in token)
        for token, i in self.added.items():
            texts[i] = token.encode()
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        self.starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        self.first = np.zeros(256, np.int64)
        for i, t in enumerate(texts):
            if len(t) == 1:
                self.first[t[0]] = i
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left, self.right, self.made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges)))
        keys = self.left << 32 | self.right
        self.by_key = np.argsort(keys)
        self.keys = keys[self.by_key]
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.reset()

    def reset(self) -> None:
        self.index = Numbers()
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        for token, i in self.added.items():  # held under keys no pre-token can have
            self.index["\0" + token]
            self.ids, self.at = np.append(self.ids, np.int32(i)), np.append(self.at, len(self.ids) + 1)
        self.index.fresh = []

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], -1)

    def merge(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of raw and where each word's begin."""
        n = len(raw)
        sym = self.first[raw]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[offsets[1:] - 1], prv[offsets[:-1]] = -1, -1
        has = np.flatnonzero(nxt >= 0)
        rank = self.ranks(sym[has], sym[has + 1])
        lists: dict[int, list] = {}

        def file(ranks: np.ndarray, places: np.ndarray, sort: bool = True) -> None:
            ok = ranks >= 0
            ranks, places = ranks[ok], places[ok]
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cut = np.flatnonzero(np.diff(ranks, prepend=-1))
            for r, i, j in zip(ranks[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(ranks)]):
                if (known := lists.get(r)) is None:
                    lists[r] = [places[i:j]]
                    heapq.heappush(heap, r)
                else:
                    known.append(places[i:j])

        heap: list[int] = []
        file(rank, has)
        rank_of = self.rank_of
        while heap:
            r = heapq.heappop(heap)
            a, b, new = int(self.left[r]), int(self.right[r]), int(self.made[r])
            found = lists.pop(r)
            place = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            if len(place) >= WIDE and a != b:
                place = place[(sym[place] == a) & (nxt[place] >= 0)]
                j = nxt[place]
                ok = sym[j] == b
                place, j = place[ok], j[ok]
                after = nxt[j]
                sym[place], sym[j], nxt[place] = new, -1, after
                some = after >= 0
                prv[after[some]] = place[some]
                before = prv[place]
                p, q = before[before >= 0], place[some]
                file(self.ranks(np.concatenate((sym[p], sym[q])), np.concatenate((sym[nxt[p]], sym[nxt[q]]))), np.concatenate((p, q)))
            else:
                for i in place.tolist():
                    if sym[i] != a or (j := nxt[i]) < 0 or sym[j] != b:
                        continue
                    after = nxt[j]
                    sym[i], sym[j], nxt[i] = new, -1, after
                    pairs = []
                    if after >= 0:
                        prv[after] = i
                        pairs.append((rank_of.get(new << 32 | int(sym[after])), i))
                    if (p := int(prv[i])) >= 0:
                        pairs.append((rank_of.get(int(sym[p]) << 32 | new), p))
                    for got, at in pairs:
                        if got is not None:
                            if (known := lists.get(got)) is None:
                                lists[got] = [np.array([at])]
                                heapq.heappush(heap, got)
                            else:
                                known.append(np.array([at]))
        alive = sym >= 0
        return sym[alive].astype(np.int32), np.concatenate(([0], np.cumsum(alive)))[offsets]

    def learn(self, words: list[str]) -> None:
        """Encode words together and keep their ids."""
        data = [w.encode() for w in words]
        ids, at = self.merge(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in data]))))
        self.at = np.concatenate((self.at, at[1:] + self.at[-1]))
        self.ids = np.concatenate((self.ids, ids))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > CACHE_WORDS:
            self.reset()
        words, sizes = [], []
        for text in texts:
            before = len(words)
            for part in self.special.split(text) if self.special and any(a in text for a in self.added) else (text,):
                if part in self.added:
                    words.append("\0" + part)
                elif part:
                    words += self.pattern.findall(part)
            sizes.append(len(words) - before)
        word = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.fresh:
            self.learn(self.index.fresh)
            self.index.fresh = []
        counts = (self.at[1:] - self.at[:-1])[word]
        ends = np.concatenate(([0], np.cumsum(counts)))
        flat = self.ids[np.repeat(self.at[word] - ends[:-1], counts) + np.arange(ends[-1])]
        cut = ends[np.cumsum(sizes)]
        return np.split(flat, cut[:-1]) if len(cut) else []

    def decode(self, ids: np.ndarray) -> str:
        size = self.starts[ids + 1] - self.starts[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.starts[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes().decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def codec(vocabulary: str) -> Codec:
    """One codec for each vocabulary in a worker's life."""
    if (key := hash(vocabulary)) not in _CODECS:
        _CODECS[key] = Codec(vocabulary)
    return _CODECS[key]


def vocabulary(path: str) -> str:
    """The text of a vocabulary file that the driver has; tasks get it as a broadcast, so they need no such file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, vocab: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every document's whole text."""
    held = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        c = codec(held.value)
        for batch in batches:
            texts = batch.column(1)
            _, off = K.column_bytes(texts)
            for i, j in K.chunks(off, 1 << 20):
                ids = c.encode([t or "" for t in texts.slice(i, j - i).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])
        c.reset()  # an idle worker holds no words

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, vocab: str) -> DataFrame:
    """encoded with the text its ids stand for; added tokens give their strings, broken UTF-8 replacement characters."""
    held = encoded.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        c = codec(held.value)
        for batch in batches:
            texts = [c.decode(np.frombuffer(x or b"", "<u4").astype(np.int64)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    prepare(docs.sparkSession)
    vocab = vocabulary(path or default_path())
    both = decode(encode(docs, vocab), vocab)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded of every row."""
    prepare(spark)
    vocab = vocabulary(default_path())
    return decode(encode(docs, vocab), vocab)
