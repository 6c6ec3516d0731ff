"""Hashes, metadata fields and dates of a document, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metadata fields, in the order the tag lists them.
ACCESSORS = ("creator", "title", "author", "subject", "keywords", "producer")
# Date fields of a document and the columns that hold them.
DATE_FIELDS = {"creationDate": "creation_date", "modDate": "mod_date"}

# Unicode white space plus the four separators U+001C to U+001F.
_WHITESPACE = r"(?U)[\s\x1c-\x1f]+"


def sha256_hex(data: Column) -> Column:
    """SHA-256 of the bytes, as lower-case hex."""
    return F.sha2(data.cast("binary"), 256)


def document_id(source_path: Column) -> Column:
    """Hash of the path; a path-less document gets the hash of a random UUID.

    The random branch changes on every evaluation: persist it before reuse.
    """
    return sha256_hex(F.coalesce(F.nullif(source_path, F.lit("")), F.uuid()))


def plain_path(uri: Column) -> Column:
    """Local path of a ``file:`` URI; other URIs are left alone."""
    return F.regexp_replace(uri, r"^file:/*(?=/)", "")


def present(value: Column) -> Column:
    """NULL for an empty string."""
    return F.nullif(value, F.lit(""))


def metadata_tag(accessors: tuple[str, ...] = ACCESSORS) -> Column:
    """``name|value`` of each non-empty field joined by ``|``, white space removed from values."""
    parts = [
        F.when(
            F.col(name) != "",
            F.concat(F.lit(f"{name}|"), F.regexp_replace(F.col(name), _WHITESPACE, "")),
        )
        for name in accessors
    ]
    return F.concat_ws("|", *parts)


def raw_metadata(names: tuple[str, ...]) -> Column:
    """Map of the named columns without empty values."""
    pairs = [item for name in names for item in (F.lit(name), F.col(name))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull() & (v != ""))


def pdf_date(text: Column) -> Column:
    """Local date of a PDF date string; NULL if it does not start with eight digits' worth of date."""
    tokens = F.filter(F.split(text, r"[:\-D]"), lambda token: token != "")
    return F.try_to_date(F.substring(F.get(tokens, F.lit(0)), 1, 8), "yyyyMMdd")


def document_dates() -> Column:
    """Map of the document's readable dates; absent ones have no key."""
    pairs = []
    for key, column in DATE_FIELDS.items():
        pairs += [F.lit(key), pdf_date(F.col(column))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
