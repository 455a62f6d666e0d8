"""Texts that stand for entities in an embedding space, and module names of paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identity import normalize_representation

BODY, DOC, SECTION, EXPORTS, SEARCH = 1200, 1000, 1500, 200, 2000


def line(label: str, value: Column) -> Column:
    """`label: value`, or null, which concat_ws leaves out."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label + ": "), value))


def lines(*parts: Column) -> Column:
    return normalize_representation(F.concat_ws("\n", *parts))


def code(kind, qualified_name, parent, path, signature, docstring, body) -> Column:
    return lines(line("kind", kind), line("name", qualified_name), line("in", parent), line("path", path), line("signature", signature), F.left(docstring, F.lit(DOC)), F.left(body, F.lit(BODY)))


def file(path, language, exports: Column, docstring, body) -> Column:
    """exports: an array of names."""
    return lines(line("file", path), line("language", language), line("exports", F.array_join(F.slice(exports, 1, EXPORTS), ", ")), F.left(docstring, F.lit(DOC)), F.left(body, F.lit(BODY)))


def section(title, ancestry: Column, path, body) -> Column:
    """ancestry: an array of the titles above."""
    return lines(line("section", F.array_join(F.concat(ancestry, F.array(title)), " > ")), line("path", path), F.left(body, F.lit(SECTION)))


def media(kind, path, start=None, end=None, context=None) -> Column:
    """An image or a span of a recording, in seconds."""
    span = F.lit(None).cast("string") if start is None else F.concat_ws("-", F.format_number(start, 1), F.format_number(end, 1))
    return lines(line(kind, path), line("span", span), line("context", F.lit(None).cast("string") if context is None else context))


def search_text(name, qualified_name, signature, docstring) -> Column:
    """What full-text search sees of an entity besides its own columns."""
    return F.left(F.concat_ws(" ", name, qualified_name, signature, docstring), F.lit(SEARCH))


def declared_modules(path: Column) -> Column:
    """Dotted names a file can be imported as: its whole path and its last part; a package's is its folder."""
    dotted = F.replace(F.regexp_replace(path, r"\.[^./]+$", ""), F.lit("/"), F.lit("."))
    package = F.replace(F.regexp_replace(path, r"/__init__\.py$", ""), F.lit("/"), F.lit("."))
    return F.when(path.rlike(r"/__init__\.py$"), F.array(package)).otherwise(F.array_distinct(F.array(dotted, F.element_at(F.split(dotted, r"\."), -1))))


#: Suffixes under which a module may lie.
MODULE_SUFFIXES = (".py", "/__init__.py", ".ts", ".tsx", ".js", ".jsx", ".rs", ".go", ".java")


def module_candidates(importer: Column, module: Column) -> Column:
    """Paths at which an imported module may lie, beside the importer first."""
    at = F.replace(module, F.lit("."), F.lit("/"))
    folder = F.regexp_extract(importer, r"^(.*)/[^/]*$", 1)
    roots = F.when(folder == "", F.array(at)).otherwise(F.array(F.concat_ws("/", folder, at), at))
    ends = F.array(*map(F.lit, MODULE_SUFFIXES))
    found = F.flatten(F.transform(roots, lambda r: F.transform(ends, lambda e: F.concat(r, e))))
    return F.when(F.coalesce(module, F.lit("")) == "", F.array().cast("array<string>")).otherwise(found)


def scope_label(source_path: Column, target_path: Column) -> Column:
    return F.when(source_path == target_path, "same_file").otherwise("cross_file")
