"""Identifiers: content hashes, keyed pseudonyms, parcel keys, canonical addresses."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordlake.functions.text import col, fold

HEX_BLOCK = 128        # a SHA-256 block is 64 bytes, 128 hex digits
MIN_KEY_CHARS = 32


def content_hash(c) -> Column:
    return F.sha2(col(c), 256)


def document_id(url) -> Column:
    """Twelve hex digits of the address hash."""
    return F.substring(content_hash(url), 1, 12)


def string_key(c) -> Column:
    return F.substring(content_hash(c), 1, 16)


def normalize_name(c) -> Column:
    """Order-insensitive, accent-insensitive form of a name."""
    tokens = F.filter(F.split(fold(c), "[^0-9a-z]+"), lambda t: t != "")
    return F.array_join(F.array_sort(tokens), " ")


def hmac_sha256(message, key: str) -> Column:
    """Keyed hash, RFC 2104, from the built-in SHA-256.

    The two padded key blocks are computed once here, so the key itself is not part of the plan.
    """
    if len(key) < MIN_KEY_CHARS:
        raise ValueError(f"the key must have at least {MIN_KEY_CHARS} characters")
    raw = key.encode("utf-8")
    if len(raw) > HEX_BLOCK // 2:
        import hashlib
        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(HEX_BLOCK // 2, b"\0")
    inner = F.unhex(F.lit(bytes(b ^ 0x36 for b in raw).hex()))
    outer = F.unhex(F.lit(bytes(b ^ 0x5C for b in raw).hex()))
    digest = F.sha2(F.concat(inner, F.encode(col(message), "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(digest)), 256)


def master_id(name, key: str) -> Column:
    message = F.concat(F.lit("master|"), normalize_name(name))
    return F.concat(F.lit("M-"), F.substring(hmac_sha256(message, key), 1, 12))


def public_id(name, doc, key: str, scope: str = "document") -> Column:
    """Per-document (or global) public identifier of a person."""
    label = (F.lit("public|") if scope == "global"
             else F.concat(F.lit("public|"), col(doc).cast("string"), F.lit("|")))
    message = F.concat(label, normalize_name(name))
    return F.concat(F.lit("P-"), F.substring(hmac_sha256(message, key), 1, 10))


def parcel_key(c) -> Column:
    """Section and number of a 14-character cadastral id; NULL when it has another shape."""
    shape = r"^\d{8}([0-9A-Z]{2})(\d{4})$"
    return F.when(col(c).rlike(shape), F.struct(
        F.regexp_replace(F.regexp_extract(col(c), shape, 1), "^0+", "").alias("section"),
        F.regexp_extract(col(c), shape, 2).alias("number")))


def pad_section(c) -> Column:
    """A one-letter section as the register writes it."""
    return F.lpad(col(c), 2, "0")


def canonical_url(c) -> Column:
    """https, host and path only; characters that could break out of a link are escaped."""
    host = F.regexp_extract(col(c), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(col(c), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    escaped = F.regexp_replace(path, r"[^A-Za-z0-9/%._~+-]", "_")
    return F.concat(F.lit("https://"), host, escaped)


def url_host(c) -> Column:
    return F.regexp_extract(col(c), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def safe_name(c) -> Column:
    """File name with a fixed set of characters, 120 at most."""
    return F.substring(F.regexp_replace(col(c), r"[^A-Za-z0-9._ -]", ""), 1, 120)
