"""Source trees as tables: listing, ignore rules, language and kind of files, generated files."""

from __future__ import annotations

import re
import subprocess
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import values as V
from ..functions.identity import content_hash
from ..operators.checkpoints import shared

IGNORE_FILES = (".gitignore", ".ignore", ".terravaneignore")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language(path: Column) -> Column:
    """By file name, then by extension; null if neither is known."""
    names = F.create_map(*[F.lit(x) for kv in V.LANGUAGE_FILENAMES.items() for x in kv])
    kinds = F.create_map(*[F.lit(x) for kv in V.LANGUAGE_EXTENSIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(base_name(path))), F.try_element_at(kinds, extension(path)))


def media_kind(path: Column) -> Column:
    """image, audio, video or document; null for others."""
    kinds = F.create_map(*[F.lit(x) for kv in V.MEDIA_EXTENSIONS.items() for x in kv])
    return F.try_element_at(kinds, extension(path))


def is_generated(path: Column, head: Column) -> Column:
    p, h = F.lower(path), F.lower(F.left(F.coalesce(head, F.lit("")), F.lit(V.HEADER_CHARS)))
    hits = [F.endswith(p, F.lit(s)) for s in V.MINIFIED_SUFFIXES] + [F.contains(p, F.lit(m)) for m in V.GENERATED_PATHS] + [F.contains(h, F.lit(m)) for m in V.GENERATED_HEADERS]
    return reduce(lambda a, b: a | b, hits)


def in_excluded_dir(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1)), F.array(*map(F.lit, V.EXCLUDED_DIRS)))


def glob_regex(pattern: str, below: str = "") -> str | None:
    """A regular expression over whole relative paths for one line of an ignore file in the folder below; None for blanks and comments."""
    p = pattern.strip()
    if not p or p.startswith(("#", "!")):
        return None
    anchored = "/" in p.rstrip("/")[0:] and not p.startswith("**/")
    folder = p.endswith("/")
    p = p.strip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and (j := p.find("]", i + 2)) > 0:
            out, i = out + "[" + p[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    base = re.escape(below.strip("/")) + "/" if below.strip("/") else ""
    return f"^{base}{'' if anchored else '(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$"


def ignored(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether some rule (folder, pattern) drops a path. A later `!` line of a folder's rules takes back what an earlier one of
    the same folder drops; one layer never takes back what another drops."""
    layers: dict[str, Column] = {}
    for below, p in rules:
        back = p.strip().startswith("!")
        if r := glob_regex(p.strip()[1:] if back else p, below):
            now = layers.get(below, F.lit(False))
            layers[below] = now & ~path.rlike(r) if back else now | path.rlike(r)
    return reduce(lambda a, b: a | b, layers.values(), F.lit(False))


MARKERS = (".git", "pyproject.toml", "package.json", "Cargo.toml", "go.mod")


def detect_root(start: str) -> str:
    """The nearest folder at or above start that holds a marker of a project, else start itself; of the driver's own disk."""
    at = Path(start).resolve()
    at = at if at.is_dir() else at.parent
    return str(next((p for p in (at, *at.parents) if any((p / m).exists() for m in MARKERS)), at))


def git_state(root: str) -> tuple[str | None, str | None]:
    """Branch and commit of a tree on the driver's disk; (None, None) where there is none."""
    said = [_git(root, "rev-parse", *a) for a in (("--abbrev-ref", "HEAD"), ("HEAD",))]
    return (said[0].strip() or None, said[1].strip() or None) if all(said) else (None, None)


def dirty_paths(spark: SparkSession, root: str, most: int = 256) -> DataFrame:
    """path of files that differ from the last commit or are new to it, `most` at most; empty where there is no repository."""
    parts, out = _git(root, "status", "--porcelain", "-z").split("\0"), []
    while parts and len(out) < most:
        x = parts.pop(0)
        if len(x) > 3:
            out.append((x[3:],))
            if x[0] in "RC" and parts:
                parts.pop(0)  # what it was called
    return spark.createDataFrame(out, "path string")


def _git(root: str, *args: str) -> str:
    try:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=5).stdout
    except (OSError, subprocess.TimeoutExpired):
        return ""


def hidden_files(spark: SparkSession, root: str) -> DataFrame:
    """path, modificationTime, length, content of files that Spark's readers leave out: of names, or below folders, that begin
    with an underscore (a package's `__init__.py`), and ignore files.

    They are found by patterns, level by level, and copied under other names to the shared folder, one at a time, from where
    Spark reads them. Folders that begin with a dot are left out, as are files over the size limit.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(conf)
    top, found, depth = fs.makeQualified(at).toString().rstrip("/"), {}, 1
    look = lambda pattern: fs.globStatus(jvm.org.apache.hadoop.fs.Path(top + pattern)) or []
    while len(look("/*" * depth)):
        for pattern in ["/*" * j + "/_*" + "/*" * (depth - 1 - j) for j in range(depth)] + ["/*" * (depth - 1) + f"/{name}" for name in IGNORE_FILES]:
            for f in look(pattern):
                path = f.getPath().toString()
                folders = path.removeprefix(top).split("/")[:-1]
                if f.isFile() and f.getLen() <= V.MAX_FILE_BYTES and not any(x.startswith(".") or x in V.EXCLUDED_DIRS for x in folders):
                    found[path] = f
        depth += 1
    staged = f"{shared(spark)}/hidden-{uuid.uuid4().hex}"
    rows = []
    for n, (path, f) in enumerate(sorted(found.items())):
        to = jvm.org.apache.hadoop.fs.Path(f"{staged}/{n}")
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, f.getPath(), to.getFileSystem(conf), to, False, conf)
        rows.append((str(n), path, f.getModificationTime(), f.getLen()))
    known = spark.createDataFrame(rows, "name string, path string, at long, length long")
    if not rows:
        return known.select("path", F.timestamp_millis("at").alias("modificationTime"), "length", F.lit(None).cast("binary").alias("content"))
    texts = spark.read.format("binaryFile").load(staged).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    empty = F.lit("").cast("binary")  # of empty files no reader gives a row
    return known.join(texts, "name", "left").select("path", F.timestamp_millis("at").alias("modificationTime"), "length", F.coalesce("content", empty).alias("content"))


def scan(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """path, size, mtime, language, media, is_generated, content_hash, content of the source files below root.

    Listing and reading are Spark's and the store's, so root can be in any store. Ignore files are read first; they are few and
    small, and their lines become one predicate.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).unionByName(hidden_files(spark, root))
    at = re.sub(r"^file:/*", "/", root).rstrip("/")
    rel = F.regexp_replace("path", "^[a-z]+:/*" + re.escape(at.lstrip("/")) + "/", "")
    files = files.where(~in_excluded_dir(rel))  # before content is asked for, so that such files are not read
    small = files.where(F.col("length") <= V.MAX_FILE_BYTES)
    files = small.select(rel.alias("path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"), "content")
    rules = [(r["path"].rpartition("/")[0], line) for r in files.where(base_name(F.col("path")).isin(*IGNORE_FILES)).select("path", F.col("content").cast("string").alias("t")).collect() for line in r["t"].splitlines()]
    keep = ~ignored(F.col("path"), rules + [("", p) for p in exclude])
    if include:
        keep &= ignored(F.col("path"), [("", p) for p in include])
    files = files.where(keep)
    head = F.when(F.col("size") <= V.HEADER_FILE_BYTES, F.col("content").cast("string"))
    files = files.withColumn("language", language(F.col("path"))).withColumn("media", media_kind(F.col("path"))).withColumn("is_generated", is_generated(F.col("path"), head))
    files = files.where((F.col("language").isNotNull() | F.col("media").isNotNull()) & ~F.col("is_generated"))
    return files.withColumn("content_hash", content_hash(F.col("content")))
