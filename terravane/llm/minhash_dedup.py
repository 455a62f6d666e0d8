"""Near-duplicate documents by min-max hashing.

Every permutation is evaluated once per shingle and leaves two signature values, the minimum and the maximum,
so 72 evaluations give 144 values: 24 bands of 6. A pair at the threshold of 0.85 shares no band with
probability (1 - 0.85**6)**24, about 1e-5.

Documents with the same shingle set are one class, known by its least doc_id; only classes are compared.
Within a band's bucket every class is compared with the bucket's most typical one (whose bands' buckets hold
most classes in all), and the links confirmed on full sets are closed into components. Where members of a
bucket still lie in different components, pairs of them across components are confirmed too, so the components
are those of all candidate pairs though pairs inside a component are never formed. The members of all buckets
with the same largest component form a cluster; those outside the component meet all others of the cluster in
blocks, a pair of blocks a task, where intersections are counted by a matrix product over the sets' hashes. A task
sends, for each class, the least one it reaches there, never pairs, and no task holds a whole cluster. A class that
leads many is dealt over salted tasks.

Defined results: null or wordless text has an empty set and links with nothing; rows with a null doc_id get a
null component_id and are not kept; rows that repeat an id are one document of the first text met.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import documents, one_row, parts, prepare, written
from .components import connected_components

PERMUTATIONS, BANDS = 72, 24
#: Members that are compared with one class in one task.
SALT_ROWS = 64
#: Members of a block; a task compares two blocks.
BLOCK = 512
#: Columns of the incidence matrices that are multiplied at once.
COLUMNS = 8192
_RNG = np.random.default_rng(77)
FLIP = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
ODD = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Per nonempty set its min and max under each permutation: rows x (2 * PERMUTATIONS)."""
    flat = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), 2 * PERMUTATIONS), dtype=np.uint64)
    for p in range(PERMUTATIONS):
        v = (flat ^ FLIP[p]) * ODD[p]
        out[:, 2 * p] = np.minimum.reduceat(v, at)
        out[:, 2 * p + 1] = np.maximum.reduceat(v, at)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    width = sig.shape[1] // BANDS
    keys = np.empty((len(sig), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        k = np.full(len(sig), b + 1, dtype=np.uint64)
        for c in range(b * width, (b + 1) * width):
            k = K.mix(k * np.uint64(0x9E3779B97F4A7C15) + sig[:, c])
        keys[:, b] = k
    return keys


FEATURES = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def features(docs: DataFrame, k: int = 3) -> DataFrame:
    """Per document the size of its shingle set, a 128-bit digest of the set, and its band keys."""

    def run(batches):
        for batch in batches:
            raw, off = K.column_bytes(batch.column(1))
            for i, j in K.chunks(off):
                sets = K.shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(n)
                a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                keys = np.zeros((0, BANDS), np.uint64)
                if len(full):
                    some = [sets[x] for x in full]
                    flat, at = np.concatenate(some), np.concatenate(([0], np.cumsum(n[full])[:-1]))
                    a[full], b[full] = np.add.reduceat(K.mix(flat), at), np.add.reduceat(K.mix(flat ^ np.uint64(0xABCDEF0123456789)), at)
                    keys = band_keys(signatures(some))
                ends = np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0)))).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), bands], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, FEATURES)


def confirm(spark: SparkSession, docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) of which 100 * intersection >= percent * union, on full sets computed from the texts.

    Rows are dealt by (a, salt), a's text goes to each of its salts; a task holds one set and one batch at a time.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    members = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
    heads = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("b"))
    asked = written(members.unionByName(heads), "asked")
    texts = docs.select(F.col("doc_id").cast("long").alias("b"), F.col("text"))
    rows = texts.join(asked.hint("merge"), "b").select("a", "salt", (F.col("a") != F.col("b")).alias("member"), "b", "text")
    rows = rows.repartition(parts(spark), "a", "salt").sortWithinPartitions("a", "salt", "member")

    def run(batches):
        head, head_id = None, None
        for batch in batches:
            ids, member, bs = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
            raw, off = K.column_bytes(batch.column(4))
            good = []
            for i, j in K.chunks(off):
                sets = K.shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
                for r in range(i, j):
                    s = sets[r - i]
                    if not member[r]:
                        if head_id != ids[r] or head is None:
                            head, head_id = s, ids[r]
                    elif head_id == ids[r] and len(s) and len(head):
                        at = np.minimum(np.searchsorted(head, s), len(head) - 1)
                        both = int(np.count_nonzero(head[at] == s))
                        if 100 * both >= percent * (len(s) + len(head) - both):
                            good.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(ids[good]), pa.array(bs[good])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of a with every set of b, by products of incidence matrices."""
    flat = np.concatenate(a + b)
    row = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in a + b])
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[col] > 1  # a shingle of one set is in no intersection
    row, col = row[shared], np.unique(col[shared], return_inverse=True)[1]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(a), len(b)), dtype=np.float64)
    for start in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        i, j = np.searchsorted(col, (start, start + COLUMNS))
        m = np.zeros((len(a) + len(b), COLUMNS), dtype=np.float32)
        m[row[i:j], col[i:j] - start] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def shingled(docs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """rep and its sorted shingle hashes, for the documents that reps names."""

    def run(batches):
        for batch in batches:
            raw, off = K.column_bytes(batch.column(1))
            for i, j in K.chunks(off):
                sets = K.shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([x.tobytes() for x in sets], pa.binary())], ["rep", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text")).join(reps.hint("merge"), "rep", "left_semi")
    return rows.mapInArrow(run, "rep long, shingles binary")


def across(spark: SparkSession, docs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components of members (cluster, rep, outside): those outside against all of the cluster."""
    size = members.groupBy("cluster").agg(F.ceil(F.count_if("outside") / BLOCK).cast("int").alias("o"), F.ceil(F.count_if(~F.col("outside")) / BLOCK).cast("int").alias("m"))
    luck = F.xxhash64("rep")
    block = F.when(F.col("outside"), F.pmod(luck, F.col("o"))).otherwise(F.col("o") + F.pmod(luck, F.greatest("m", F.lit(1)))).cast("int")
    m = members.join(written(size, "clusters"), "cluster").withColumn("block", block)
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("outside"), F.col("o") + F.col("m")).otherwise(F.col("o")) - 1)))
    m = m.select("cluster", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "rep")
    asked = written(m, "blocks")
    hashed = written(shingled(docs, members.select("rep").distinct(), k), "sets")  # a text is cut into shingles once, whatever the blocks it goes to
    rows = hashed.join(asked, "rep").select("cluster", "bi", "bj", "block", "rep", "shingles")
    rows = rows.repartition(parts(spark), "cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj", "block", "rep")

    def solve(key, block, rep, sets):
        rep, block = np.array(rep), np.array(block)
        keep = np.concatenate(([True], rep[1:] != rep[:-1]))  # a repeated id once
        left = np.flatnonzero(keep & (block == key[1]))
        right = left if key[1] == key[2] else np.flatnonzero(keep & (block == key[2]))
        if not len(left) or not len(right):
            return None
        n = np.array([len(s) for s in sets], dtype=np.float64)
        both = intersections([sets[x] for x in left], [sets[x] for x in right])
        i, j = np.nonzero((100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)) & (both > 0))
        i, j = left[i], right[j]
        i, j = i[i != j], j[i != j]
        if not len(i):
            return None
        label = np.arange(len(rep))
        while True:  # the least place each reaches; a forest of links instead of all of them
            low = label.copy()
            np.minimum.at(low, i, label[j])
            np.minimum.at(low, j, low[i])
            low = low[low]
            if (low == label).all():
                break
            label = low
        some = np.flatnonzero(label != np.arange(len(rep)))
        return pa.RecordBatch.from_arrays([pa.array(rep[label[some]]), pa.array(rep[some])], ["a", "b"])

    def run(batches):
        key, block, rep, sets = None, [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            c, bi, bj, bl, rp = (batch.column(x).to_numpy() for x in range(5))
            found = [np.frombuffer(x, np.uint64) for x in batch.column(5).to_pylist()]
            cut = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1]))))
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(c)]):
                if (now := (c[s], bi[s], bj[s])) != key:
                    if key is not None and (out := solve(key, block, rep, sets)) is not None:
                        yield out
                    key, block, rep, sets = now, [], [], []
                block += bl[s:e].tolist()
                rep += rp[s:e].tolist()
                sets += found[s:e]
        if key is not None and (out := solve(key, block, rep, sets)) is not None:
            yield out

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    prepare(spark)
    found = written(features(docs, k), "features")
    ok = found.where("doc_id is not null and n_shingles > 0")
    classes = written(ok.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")), "classes")
    member = classes.select("rep", "n_shingles", F.explode("bands").alias("band")).distinct()
    sizes = member.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    member = written(member.join(sizes, "band"), "members")
    typical = written(member.groupBy("rep").agg(F.sum("size").alias("typical")), "typical")
    leads = member.join(typical, "rep").groupBy("band").agg(F.max_by(F.struct("rep", "n_shingles"), F.struct("typical", -F.col("rep"))).alias("lead"))
    buckets = member.join(written(leads, "leads"), "band").select("band", "rep", "n_shingles", F.col("lead.rep").alias("a"), F.col("lead.n_shingles").alias("na"), "size")
    buckets = written(buckets, "buckets")
    fits = f"100 * least(n_shingles, na) >= {percent} * greatest(n_shingles, na)"
    pairs = written(buckets.where("rep <> a").where(fits).select("a", F.col("rep").alias("b")).distinct(), "pairs")
    links = written(confirm(spark, docs, pairs, k, percent), "confirmed")
    comps = written(connected_components(links), "components")
    # Members of one bucket in different components: the pairs that stars have not compared.
    left = buckets.where("size > 2").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    left = written(left.select("band", "rep", "n_shingles", F.coalesce("component", "rep").alias("component")), "left")
    sizes = left.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("band").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    left = left.join(main, "band").select(F.col("main").alias("cluster"), "rep", (F.col("component") != F.col("main")).alias("outside")).distinct()
    left = written(left, "left")
    if not left.isEmpty():
        links = written(links.union(across(spark, docs, left, k, percent)), "links")
        comps = written(connected_components(links), "components")
    named = classes.select("set_a", "set_b", "n_shingles", "rep").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = written(named.select("set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("least")), "named")
    out = found.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


#: All pairs that share a shingle, brute force; for small tables.
ORACLE = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS o FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) e ON r.o = e.a),
c AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY ALL)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, with its columns; five-word shingles and a similarity of 0.8.

    Rows that repeat an id are one document: one of them, that of greatest hash, stands for it. Rows without an id stay.
    """
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if not ids.where("n > 1").isEmpty():
        one = one_row(docs.where("doc_id is not null"), docs["doc_id"]).select("_row.*")
        docs = written(one.unionByName(docs.where("doc_id is null")), "one-row")
    found = written(near_duplicates(spark, docs, k=5, percent=80), "near")
    gone = found.where("not kept and doc_id is not null").select("doc_id")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
