"""Keyed pseudonyms that keep a snapshot's shape (R-143..R-150)."""

from __future__ import annotations

import hashlib
import hmac
import json
import struct
import zlib
from base64 import b32encode

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_SECRET, KEPT_BYTES = 32, 12
#: What every address of a link becomes, and the content that stands for assets that are no images.
REDACTED_URL = "https://redacted.example"
OTHER = b"\0"


def pixel() -> bytes:
    """A transparent PNG of one pixel, which stands for images."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", 1, 1, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(bytes(5))) + chunk(b"IEND", b"")


def checked(secret: bytes) -> bytes:
    if len(secret) < LEAST_SECRET:
        raise ValueError(f"a secret has {LEAST_SECRET} bytes at least")
    return secret


def sanitized(secret: bytes, text: str | None) -> str | None:
    """R-143 in Python: the first bytes of the HMAC in base 32."""
    return b32encode(hmac.digest(secret, text.encode(), "sha256")[:KEPT_BYTES]).decode().rstrip("=") if text else text


def sanitize_id(c: Column, secret: bytes) -> Column:
    """R-143 in the JVM: HMAC-SHA256 of two SHA-256 rounds; empty stays empty and null null."""
    key = checked(secret) if len(secret) <= 64 else hashlib.sha256(secret).digest()
    pad = lambda b: F.lit(bytes(x ^ b for x in key.ljust(64, b"\0")))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(c, "UTF-8")), 256))
    digest = F.sha2(F.concat(pad(0x5C), inner), 256)
    bits = F.concat(F.substring(digest, 1, 2 * KEPT_BYTES), F.lit("0"))  # 96 bits and four zeros: 20 digits of five bits
    groups = [F.lpad(F.conv(F.substring(bits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(5)]
    digits = F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.when(c == "", F.lit("")).otherwise(digits)


def sanitize_composite(c: Column, secret: bytes, known_types: list[str]) -> Column:
    """R-144: each part between colons, but for names of known resource types; without a colon the whole."""
    known = F.array(*map(F.lit, known_types)).cast("array<string>")
    parts = F.transform(F.split(c, ":"), lambda p: F.when((p != "") & F.array_contains(known, p), p).otherwise(sanitize_id(p, secret)))
    return F.when(F.contains(c, F.lit(":")), F.array_join(parts, ":")).otherwise(sanitize_id(c, secret))


def sanitize_email(c: Column, secret: bytes) -> Column:
    """R-145: the part before the last @, and the domain as a name under .example; without an @ the whole."""
    domain = F.substring_index(c, "@", -1)
    local = F.left(c, F.length(c) - F.length(domain) - 1)
    whole = F.concat(sanitize_id(local, secret), F.lit("@dom-"), F.lower(sanitize_id(domain, secret)), F.lit(".example"))
    return F.when(F.contains(c, F.lit("@")), whole).otherwise(sanitize_id(c, secret))


def sanitized_json(secret: bytes, value):
    if isinstance(value, str):
        return sanitized(secret, value)
    if isinstance(value, dict):
        return {k: sanitized_json(secret, v) for k, v in value.items()}
    return [sanitized_json(secret, v) for v in value] if isinstance(value, list) else value


def sanitize_json(c: Column, secret: bytes) -> Column:
    """R-146: strings at any depth; keys, numbers and booleans stay. Its recursion is what an Arrow UDF is for."""

    @F.pandas_udf("string")
    def walked(text: pd.Series) -> pd.Series:
        return text.map(lambda x: None if x is None else json.dumps(sanitized_json(secret, json.loads(x)), separators=(",", ":"), ensure_ascii=False))

    return walked(c)


def shift(c: Column, anchor: Column, latest: Column) -> Column:
    """R-147: the same offset for all times, which brings the latest to the anchor; null stays null, and so do all without a latest."""
    moved = F.timestamp_micros(F.unix_micros(c) + F.unix_micros(anchor) - F.unix_micros(latest))
    return F.when(c.isNotNull() & latest.isNotNull(), moved).otherwise(c)


def redact_url(c: Column) -> Column:
    """R-148."""
    return F.when(c.isNotNull() & (c != ""), F.lit(REDACTED_URL)).otherwise(c)


def placeholder(content_type: Column) -> Column:
    """R-148: content of an asset by its type: a pixel for images, else a single byte, for an empty asset would be dropped."""
    return F.when(F.lower(content_type).startswith("image/"), F.lit(pixel())).otherwise(F.lit(OTHER))


def known_annotations(annotations: Column, types: list[str]) -> Column:
    """R-148: the annotations whose type a handler knows."""
    return F.filter(annotations, lambda a: a["type_url"].isin(types))


def dropped_annotations(df: DataFrame, column: str, types: list[str]) -> DataFrame:
    """R-148: how many annotations of each unknown type go."""
    return df.select(F.explode(column).alias("a")).where(~F.col("a.type_url").isin(types)).groupBy(F.col("a.type_url").alias("type_url")).agg(F.count(F.lit(1)).alias("n"))


def type_token(c: Column, secret: bytes, known_types: list[str]) -> Column:
    return F.when((c == "") | c.isin(known_types), c).otherwise(sanitize_id(c, secret))
