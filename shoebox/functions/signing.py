"""HMAC-SHA256 links as column expressions.

The two key pads become plan literals, so plans and event logs of a signing
job carry the secret and must be kept private.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

SIGNING_WINDOW_SECONDS = 300
DEFAULT_TTL_SECONDS = 21_600
MAX_TTL_SECONDS = 86_400


def base64url(binary: Column) -> Column:
    """Unpadded URL-safe text; the line breaks of ``base64`` are dropped too."""
    return F.translate(F.base64(binary), "+/=\r\n", "-_")


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """Binary HMAC from two nested hashes, with no UDF."""
    key = hashlib.sha256(secret).digest() if len(secret) > 64 else secret
    key = key.ljust(64, b"\0")
    inner_pad = F.lit(bytearray(b ^ 0x36 for b in key))
    outer_pad = F.lit(bytearray(b ^ 0x5C for b in key))
    inner = F.unhex(F.sha2(F.concat(inner_pad, message.cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(outer_pad, inner), 256))


def bounded_ttl(ttl: Column) -> Column:
    return F.when(ttl.between(SIGNING_WINDOW_SECONDS, MAX_TTL_SECONDS), ttl).otherwise(
        DEFAULT_TTL_SECONDS
    )


def expiry(now_seconds: Column, ttl: Column) -> Column:
    """Next window boundary plus the bounded time to live, in seconds."""
    window = SIGNING_WINDOW_SECONDS
    return (
        F.ceil(now_seconds / window).cast("bigint") * window + bounded_ttl(ttl).cast("bigint")
    )


def link_signature(encoded_path: Column, expires: Column, secret: bytes) -> Column:
    message = F.concat(F.lit("media:"), encoded_path, F.lit(":"), expires.cast("string"))
    return base64url(hmac_sha256(message, secret))


def signed_url(base_url: str, encoded_path: Column, expires: Column, secret: bytes) -> Column:
    return F.concat(
        F.lit(base_url.rstrip("/") + "/"), encoded_path,
        F.lit("?expires="), expires.cast("string"),
        F.lit("&signature="), link_signature(encoded_path, expires, secret),
    )


def verified_expiry(url: Column, now_seconds: Column, secret: bytes) -> Column:
    """Expiry of a well-formed, unexpired, correctly signed link, else null."""
    if len(secret) < 32:
        return F.lit(None).cast("bigint")
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]+/+([^?#]*)", 1)
    query = F.concat(F.lit("&"), F.regexp_extract(url, r"\?([^#]*)", 1))
    expires_text = F.regexp_extract(query, r"&expires=([^&]*)", 1)
    signature = F.regexp_extract(query, r"&signature=([^&]*)", 1)
    expires = expires_text.try_cast("bigint")
    good = (
        expires_text.rlike(r"\A[1-9]\d*\z")
        & signature.rlike(r"\A[A-Za-z0-9_-]{43}\z")
        & (expires <= 2**53 - 1)
        & (expires > now_seconds)
        & (link_signature(path, expires_text, secret) == signature)
    )
    return F.when(good, expires)
