"""Ids and hashes: frozen contracts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of the parts joined by ||; a null part counts as ''."""
    return F.substring(F.sha1(F.concat_ws("||", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary")), 1, 16)


def edited_id(text: Column) -> Column:
    return F.concat(F.lit("ed_"), F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 16))


def url_document_id(url: Column, content_hash: Column) -> Column:
    """A document's id from where it was and what it held."""
    return stable_id(url, content_hash)


def object_path(section: Column, title_slug: Column, url: Column, suffix: str) -> Column:
    """section/slug_ and the first 8 hex digits of the URL's MD5."""
    name = F.concat_ws("_", title_slug, F.substring(F.md5(url.cast("binary")), 1, 8))
    return F.concat(F.concat_ws("/", section, name), F.lit(suffix))
