"""Identifiers from content: SHA-256 and name-based UUIDs as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The DNS namespace of name-based UUIDs, and the tag that index document ids start with.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
DOCUMENT_TAG = "index-document-v1"


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def document_id(repository: Column, path: Column, hash_: Column, index: Column, start: Column, end: Column) -> Column:
    """The id of a chunk's index document; the revision takes no part, so unchanged chunks keep their id."""
    parts = [F.lit(DOCUMENT_TAG), repository, path, hash_, *(c.cast("string") for c in (index, start, end))]
    return F.sha2(F.concat_ws("\0", *parts), 256)


def uuid5(name: Column) -> Column:
    """The version-5 UUID of a name in the DNS namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), name.cast("binary")))
    # The variant bits: the digit's lower two bits under binary 10.
    variant = F.substr(F.lit("89ab"), (F.conv(F.substr(digest, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4) + 1, F.lit(1))
    cut = lambda a, n: F.substr(digest, F.lit(a), F.lit(n))
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("5"), cut(14, 3)), F.concat(variant, cut(18, 3)), cut(21, 12))


def local_repository_id(name: Column, path: Column) -> Column:
    """local__slug__first 12 digits of the path's hash."""
    slug = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.concat_ws("__", F.lit("local"), F.when(slug == "", "repository").otherwise(slug), F.substr(F.sha2(path, 256), F.lit(1), F.lit(12)))


def github_repository_id(owner: Column, repository: Column) -> Column:
    return F.concat_ws("__", F.lit("github"), F.lower(owner), F.lower(repository))


def token_prefix(token: Column) -> Column:
    return F.concat(F.substr(token, F.lit(1), F.lit(len("sc_live_") + 6)), F.lit("..."))
