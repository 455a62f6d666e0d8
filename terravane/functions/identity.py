"""Stable ids, normal paths and hashes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import UNIT_SEPARATOR


def text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def normalize_path(path: Column) -> Column:
    """Forward slashes, trimmed, without leading ./ and without slashes at either end."""
    p = F.trim(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.trim(F.regexp_replace(p, r"^(\./)+", ""), F.lit("/"))


def joined_hash(*parts: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the parts joined by the unit separator; a null is empty, not left out."""
    return F.left(F.sha2(F.concat_ws(UNIT_SEPARATOR, *map(text, parts)).cast("binary"), 256), F.lit(32))


def stable_id(root_id, kind, language, path, qualified_name, discriminator) -> Column:
    return F.concat(kind, F.lit(":"), joined_hash(root_id, kind, language, normalize_path(path), qualified_name, discriminator))


def edge_id(source, kind, target, provenance, resolver) -> Column:
    return F.concat(F.lit("edge:"), joined_hash(source, kind, target, provenance, resolver))


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def normalize_representation(value: Column) -> Column:
    """Trailing blanks of lines go, runs of blank lines become one, the ends are trimmed."""
    v = F.regexp_replace(value, r"[ \t\r]+(?=\n|\z)", "")  # `$` would also stand before a last line break
    return F.regexp_replace(F.regexp_replace(v, r"\n{3,}", "\n\n"), r"^\s+|\s+\z", "")
