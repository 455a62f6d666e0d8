"""Personal data: fixed patterns, and bootstrapped contextual extraction of identifiers that no pattern names.

The base finds e-mail addresses, IP addresses, payment cards and phone numbers; its spans, and values in published
credential formats that are assigned to a key (SECRET), are the seed entities. A seed induces lexical patterns of
what stands around it: the key it is assigned to; the two words before it; the word before it with the form of the
slot; and, most general, the classes of the words before and after it with the form of the slot. The form of a slot
is the value's run of letters, digits and marks. Patterns that SUPPORT distinct seeds induce take part.

A second pass over the texts finds all strings in the slots of these patterns, whatever they look like. Patterns and
distinct strings (instances) are a bipartite graph that Spark scores in rounds: seeds count 1; ordinary words (letters
alone) count 0; any other string counts as its best pattern did in the round before, nothing at first, with a weight of
UNKNOWN at least. A pattern's confidence is the weighted mean, smoothed by one missing instance. A string is therefore
believed only through patterns that seeds induced: without seeds nothing passes. Patterns of CONFIDENCE at least
name the strings they extract; these are added with the kind `context`, base spans stay as they are.

Frequent word pairs become patterns as the corpus grows, and all words that follow them stand in their slots. Of ordinary
words only the number of distinct ones in a slot is asked for; they leave a task as lists of distinct words, not as rows,
and neither the graph nor the spans that are reported hold them.

Defined results: null or empty text has no spans; offsets are code points, ends exclusive; rows that repeat an id, or
have none, each keep their own row; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, prepare, written

KINDS = ("email", "ip", "card", "phone", "context")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Credential formats as their issuers publish them, and the widths of hexadecimal digests.
SECRET = re.compile(r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{24,}|[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})(?![A-Za-z0-9])")
TOKEN = re.compile(r"\S+")
MARKED = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
ASSIGNED = re.compile(r"[=:]\s{0,8}[\"'(\[{<]*([^\s\"'(\[{<]\S*)")
RUN = re.compile(r"[+(]?[0-9][0-9 ().-]*[0-9]")  # digits with blanks between
GROUPS = re.compile(r"(?<![A-Za-z0-9])(?=[A-Z]{0,3}[0-9])[A-Z0-9]{4}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?(?![A-Za-z0-9])")  # an identifier written in groups of four
KEY = re.compile(r"([A-Za-z_][\w.-]*)\s*[=:]\s*[\"'(\[{<]*$")
FORM = re.compile(r"[^\W_]+")
OPENING, CLOSING = "\"'([{<", ".,;:!?\"')]}>"
ROUNDS, SUPPORT, CONFIDENCE, UNKNOWN = 4, 5, 0.6, 0.1
FILTER_BITS = 24  #: The second pass asks a bitmap of 2**24 bits first; a join then decides exactly.
CONTEXT = 80  #: Characters on either side of a string in which its words are looked for.
LAST_WORDS = 100_000  #: Words that are sent to tasks at most.
SALTS = 32  #: Parts of a pattern's instances in joins, and of its ordinary words; one pattern may hold a third of them.
WORDS_HELD = 200_000  #: Distinct ordinary words (by pattern) that a task holds before it hands them on; the rest follow in further lists.
CREDENTIAL, SEED, OTHER, ORDINARY = 3, 2, 1, 0  #: From SEED on, a string is a seed; a base span has SEED.


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted. An e-mail's local part is the whole run before its @, back to the last match's end."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def run_form(m) -> str:
    run = m.group()
    digits = sum(c.isdigit() for c in run)
    if not digits:
        return "a"
    if digits == len(run):
        return f"d{len(run)}" if len(run) >= 5 else "d"
    return f"m{len(run)}" if len(run) >= 12 else "m"


def form(value: str) -> str:
    """A value's runs of letters (a), digits (d, from five on with their number) and both (m, from twelve on), and its marks."""
    out = FORM.sub(run_form, value)
    return out if len(out) <= 80 else f"long{zlib.crc32(out.encode('utf-8', 'replace'))}"


def word_class(word: str) -> str:
    return "^" if not word else "w" if any(map(str.isalpha, word)) else "9" if any(map(str.isdigit, word)) else "."


def patterns_of(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns in whose slot text[start:end] stands."""
    left = text[max(0, start - CONTEXT) : start]
    after = text[end : end + CONTEXT].split(None, 1)
    after, slot = word_class(after[0] if after else ""), form(text[start:end])
    if m := KEY.search(left):
        return [f"key:{m.group(1).lower()}", f"around:=_{after}|{slot}"]
    words = left.rstrip(OPENING).lower().split()
    one, two = (words[-1] if words else ""), (words[-2] if len(words) > 1 else "")
    out = [f"around:{word_class(one)}_{after}|{slot}"]
    if one:
        out.append(f"left:{one}|{slot}")
    if two:
        out.append(f"before:{two} {one}")
    return out


def held(bitmap: bytes, pattern: str) -> int:
    at = zlib.crc32(pattern.encode("utf-8", "replace")) >> (32 - FILTER_BITS)
    return bitmap[at >> 3] >> (at & 7) & 1


def seeds_of(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Base spans and assigned credentials, in order."""
    out = [(s, e) for s, _, e in base]
    for m in ASSIGNED.finditer(text):
        if g := SECRET.match(text, m.start(1)):
            if not any(s < g.end() and e > g.start() for s, e in out):
                out.append(g.span())
    return sorted(set(out))


def after_held(words: list[str], bitmap: bytes) -> bool:
    """Whether two words in a row are such that the bitmap may hold the pattern of what follows, or too long to tell here."""
    if max(map(len, words), default=0) > CONTEXT // 4:
        return True
    crc, shift = zlib.crc32, 32 - FILTER_BITS
    for pair in zip(words, words[1:]):
        at = crc(("before:%s %s" % pair).encode("utf-8", "replace")) >> shift
        if bitmap[at >> 3] >> (at & 7) & 1:
            return True
    return False


def strings_of(text: str, taken: list[tuple[int, int]], bitmap: bytes, every: bool | frozenset) -> list[tuple[int, int]]:
    """Strings that may stand in a slot, outside taken: numbers and groups, tokens with a digit or @, assigned values; if every, also the words after two words that the bitmap may hold
    (every: True, or the last words of such pairs)."""
    found = []
    if DIGIT.search(text) or "@" in text:
        found += [(*m.span(), 0) for m in RUN.finditer(text) if " " in m.group() and sum(map(str.isdigit, m.group())) >= 7]
        found += [(*m.span(), 0) for m in GROUPS.finditer(text) if sum(map(str.isdigit, m.group())) >= 8]
        found += [(*m.span(), 1) for m in MARKED.finditer(text)]
    if "=" in text or ":" in text:
        found += [(*m.span(1), 2) for m in ASSIGNED.finditer(text)]
    words = text.lower().split() if every else []
    if every and not (isinstance(every, frozenset) and every.isdisjoint(words)) and after_held(words, bitmap):
        two, one = ("", 0), ("", 0)
        for m in TOKEN.finditer(text):
            s = m.start()
            if two[0] and (s - two[1] > CONTEXT or held(bitmap, f"before:{two[0]} {one[0]}")):
                found.append((*m.span(), 1))
            two, one = one, (m.group().lower(), s)
    out, done, k = [], 0, 0
    for s, e, kind in sorted(found, key=lambda x: (x[0], x[2])):
        if s < done:
            continue
        if kind:
            word = text[s:e]
            if kind == 1 and (cut := min((i for c in "=:" if (i := word.find(c)) > 0), default=-1)) >= 0 and cut + 1 < len(word):
                continue  # key=value: the value comes by itself
            while s < e and text[s] in OPENING:
                s += 1
            while e > s and text[e - 1] in CLOSING:
                e -= 1
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if e > s and not any(a < e and b > s for a, b in taken[k : k + 3]):
            out.append((s, e))
            done = e
    return out


def instances(text: str, base: list[tuple[int, int, int]], bitmap: bytes | None = None, every: bool | frozenset = False, hide: int = 0) -> list[tuple[int, int, str, str, int]]:
    """(start, end, pattern, value, mark) of seeds; with a bitmap, of all strings in its patterns' slots. Seeds in one of `hide` parts are taken for strings."""
    seeds = seeds_of(text, base)
    known = {(s, e) for s, _, e in base}
    spans = [(s, e, SEED if (s, e) in known else CREDENTIAL) for s, e in seeds]
    if bitmap is not None:
        spans += [(s, e, OTHER) for s, e in strings_of(text, seeds, bitmap, every)]
    out = []
    for s, e, mark in spans:
        value = text[s:e]
        if mark >= SEED and hide and zlib.crc32(value.encode("utf-8", "replace")) % hide == 0:
            mark = OTHER
            if bitmap is None:
                continue
        elif mark == OTHER and value.replace("'", "").isalpha():
            mark = ORDINARY
        out += [(s, e, x, value, mark) for x in patterns_of(text, s, e) if bitmap is None or held(bitmap, x)]
    return out


SCAN = (
    "doc_id long, spans array<struct<start:long,kind:int,end:long>>, found array<struct<start:long,end:long,pattern:string,value:string,mark:int>>, "
    "words array<struct<pattern:string,part:int,list:array<string>>>"
)


def dealt(held: dict[str, set[str]]) -> list[dict]:
    """The words of each pattern in SALTS parts, by their checksum: equal words of a pattern are in equal parts."""
    out = []
    for pattern, words in held.items():
        lists: dict[int, list[str]] = {}
        for w in words:
            lists.setdefault(zlib.crc32(w.encode("utf-8", "replace")) % SALTS, []).append(w)
        out += [{"pattern": pattern, "part": k, "list": x} for k, x in lists.items()]
    return out


def scan(docs: DataFrame, bitmap: bytes | None = None, every: bool | frozenset = False, hide: int = 0) -> DataFrame:
    """Base spans and instances of every whole text. Ordinary words come in `words`, on any row of their task; those that might be a seed elsewhere, a credential of letters alone, in `found`."""
    sent = docs.sparkSession.sparkContext.broadcast((bitmap, every))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    found = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.string()), ("value", pa.string()), ("mark", pa.int32())]))
    words = pa.list_(pa.struct([("pattern", pa.string()), ("part", pa.int32()), ("list", pa.list_(pa.string()))]))
    names = [[f.name for f in t.value_type] for t in (spans, found)]
    most = WORDS_HELD

    def run(batches):
        held, n, ready = {}, 0, None  # the last batch waits, for the words of all

        def out():
            lists = [dealt(held), *[[]] * (len(ready[0]) - 1)]
            return pa.RecordBatch.from_arrays([*ready, pa.array(lists, words)], ["doc_id", "spans", "found", "words"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if ready:
                if n < most:
                    yield pa.RecordBatch.from_arrays([*ready, pa.array([[]] * len(ready[0]), words)], ["doc_id", "spans", "found", "words"])
                else:
                    yield out()
                    held, n = {}, 0
            base, more = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                b = base_spans(text)
                base.append([dict(zip(names[0], x)) for x in b])
                kept = []
                for x in instances(text, b, *sent.value, hide):
                    if x[4] == ORDINARY and not SECRET.fullmatch(x[3]):
                        own = held.setdefault(x[2], set())
                        n -= len(own)
                        own.add(x[3])
                        n += len(own)
                    else:
                        kept.append(dict(zip(names[1], x)))
                more.append(kept)
            ready = [batch.column(0), pa.array(base, spans), pa.array(more, found)]
        if ready:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, SCAN)


def word_counts(rows: DataFrame) -> DataFrame:
    """pattern, ordinary: how many distinct ordinary words the lists of scan() hold; a part of a pattern's meets in one task."""
    lists = rows.where(F.size("words") > 0).select(F.explode("words").alias("w")).select("w.pattern", "w.part", "w.list")
    part = lists.groupBy("pattern", "part").agg(F.size(F.array_distinct(F.flatten(F.collect_list("list")))).alias("n"))
    return part.groupBy("pattern").agg(F.sum("n").alias("ordinary"))


def induced(found: DataFrame) -> DataFrame:
    """Patterns that enough distinct seeds induce."""
    pair = found.where(F.col("mark") >= SEED).groupBy("pattern", F.xxhash64("value").alias("instance")).agg(F.lit(1).alias("one"))
    return pair.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT).select("pattern")


def bits(patterns: DataFrame) -> bytes:
    """A bitmap of the patterns' checksums, of one size whatever their number."""
    at = F.shiftrightunsigned(F.crc32(F.encode("pattern", "utf-8")), 32 - FILTER_BITS)
    word = patterns.select(at.alias("at")).groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("set")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 5), dtype="<u4")
    out[word["word"].to_numpy(np.int64)] = word["set"].to_numpy(np.int64).astype("<u4")
    return out.tobytes()


def last_words(patterns: DataFrame) -> bool | frozenset:
    """The last words of patterns of two words, to pass over texts quickly; True where they are more than LAST_WORDS, which finds the same."""
    last = patterns.where("pattern like 'before:%'").select(F.substring_index("pattern", " ", -1).alias("w")).distinct()
    found = [r["w"] for r in last.limit(LAST_WORDS + 1).collect()]
    return bool(found) and (True if len(found) > LAST_WORDS else frozenset(found))


def salted(patterns: DataFrame) -> DataFrame:
    return patterns.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def salt():
    return F.pmod(F.col("instance"), F.lit(SALTS)).cast("int")


def confidences(score: DataFrame, ordinary: DataFrame) -> DataFrame:
    """pattern, confidence, seeds: the weighted mean of its instances' scores, its ordinary words' and that of one missing instance; sums are combined before the shuffle."""
    weight = F.when(F.col("mark") == OTHER, F.greatest(F.lit(UNKNOWN), F.col("score"))).otherwise(F.lit(1.0))
    sums = score.groupBy("pattern").agg(F.sum(weight * F.col("score")).alias("won"), F.sum(weight).alias("all"), F.count_if(F.col("mark") >= SEED).alias("seeds"))
    return sums.join(ordinary, "pattern", "left").select("pattern", (F.col("won") / (F.col("all") + F.coalesce("ordinary", F.lit(0)) + 1)).alias("confidence"), "seeds")


def scored_patterns(found: DataFrame, able: DataFrame | None = None, rounds: int = ROUNDS, words: DataFrame | None = None) -> DataFrame:
    """pattern, confidence and seeds after the rounds, from (pattern, value, mark) rows; pairs count once whatever their number.

    Ordinary words never change their score, so of them only the number in each pattern's slot takes part; words: those
    that are not among the rows, counted (word_counts).
    """
    every = found.groupBy("pattern", F.xxhash64("value").alias("instance")).agg(F.max("mark").alias("mark")).withColumn("salt", salt())
    every = written(every if able is None else every.join(salted(able), ["pattern", "salt"], "left_semi"), "graph")
    ordinary = every.where(F.col("mark") == ORDINARY).groupBy("pattern").agg(F.count(F.lit(1)).alias("ordinary"))
    if words is not None:
        ordinary = ordinary.union(words).groupBy("pattern").agg(F.sum("ordinary").alias("ordinary"))
    ordinary = written(ordinary, "ordinary")
    pair = every.where(F.col("mark") != ORDINARY)
    start = F.when(F.col("mark") >= SEED, 1.0).otherwise(0.0)
    score = pair.withColumn("score", start)
    for _ in range(rounds - 1):
        known = pair.join(salted(confidences(score, ordinary).select("pattern", "confidence")), ["pattern", "salt"]).groupBy("instance").agg(F.max("confidence").alias("best"))
        new = written(pair.join(known, "instance").withColumn("score", F.when(F.col("mark") == OTHER, F.col("best")).otherwise(start)).select("pattern", "instance", "mark", "salt", "score"), "scores")
        discard(score)
        score = new
    out = written(confidences(score, ordinary), "confidences")
    discard(score, every, ordinary)
    return out


def personal_data(docs: DataFrame, hide: int = 0) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, end) of every row. hide: for tests, see instances()."""
    prepare(docs.sparkSession)
    able = written(induced(scan(docs, hide=hide).select(F.explode("found").alias("f")).select("f.*")), "induced")
    every = last_words(able)
    rows = written(scan(docs, bits(able), every, hide).withColumn("row", F.monotonically_increasing_id()), "scan")
    found = rows.select("row", F.explode("found").alias("f")).select("row", "f.*").withColumn("instance", F.xxhash64("value")).withColumn("salt", salt())
    good = scored_patterns(found, able, words=word_counts(rows)).where((F.col("seeds") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)).select("pattern")
    more = found.where(F.col("mark").isin(OTHER, CREDENTIAL)).join(salted(good), ["pattern", "salt"], "left_semi").groupBy("row").agg(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end")).alias("more"))
    out = rows.select("row", "doc_id", "spans").join(more, "row", "left")
    empty = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    return out.select("doc_id", F.col("spans").alias("base"), F.array_sort(F.concat("spans", F.coalesce("more", empty))).alias("spans"))


def listed(spans):
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir))
    number = lambda k, c="base": F.size(F.filter(c, lambda x: x["kind"] == k)).cast("long")
    base = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return found.select("doc_id", *base, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), number(4, "spans").alias("n_context"), F.size("spans").cast("long").alias("n_spans"))
