"""Digests and keyed digests from Spark's own functions; no Python rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.functions.text import trim


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def sha1_hex(c: Column) -> Column:
    return F.sha1(c.cast("binary"))


def peppered(ip: Column, pepper: str) -> Column:
    """Digest of an address with a pepper; empty without one."""
    return sha256_hex(F.concat(ip, F.lit(pepper))) if pepper else F.lit("")


def hmac_sha256_hex(message: Column, key: str | bytes) -> Column:
    """HMAC-SHA256 with a fixed key: the two padded keys are constants, the digests are Spark's."""
    import hashlib

    raw = key.encode() if isinstance(key, str) else key
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def same_hex(a: Column, b: Column) -> Column:
    """Hex digests compared without regard to case; malformed ones are never equal."""
    well = a.rlike(r"^([0-9a-fA-F]{2})+$") & b.rlike(r"^([0-9a-fA-F]{2})+$")
    return F.coalesce(well & (F.lower(a) == F.lower(b)), F.lit(False))


def base64url(c: Column) -> Column:
    plain = F.replace(F.replace(F.base64(c.cast("binary")), F.lit("\r\n"), F.lit("")), F.lit("="), F.lit(""))
    return F.translate(plain, "+/", "-_")


def from_base64url(c: Column) -> Column:
    plain = F.translate(c, "-_", "+/")
    return F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("=")))


def too_large(payload: Column, limit: int = 32 * 1024) -> Column:
    return F.octet_length(payload) > limit


def token_state(claims: Column, now: Column, skew: int = 60) -> Column:
    """ok, expired, invalid or malformed of a token's claims JSON: sub, exp and iat in epoch seconds."""
    fields = F.from_json(claims, "sub string, iat long, exp long")
    broken = claims.isNull() | (F.coalesce(trim(claims), F.lit("")) == "") | fields["exp"].isNull() | fields["sub"].isNull()
    return F.when(broken, "malformed").when(fields["exp"] + skew < now, "expired").when(fields["iat"] - skew > now, "invalid").otherwise("ok")


def signed_token(claims: Column, key: str) -> Column:
    """A token of a fixed header, the claims' JSON and their HMAC-SHA256, each in base64url."""
    body = F.concat(F.lit("eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9."), base64url(claims))
    return F.concat(body, F.lit("."), base64url(F.unhex(hmac_sha256_hex(body, key))))


def token_check(token: Column, key: str, now: Column, skew: int = 60) -> Column:
    """ok, expired, invalid or malformed of a signed token: its signature is compared before its claims are read."""
    parts = F.split(token, r"\.")
    body = F.concat_ws(".", F.get(parts, 0), F.get(parts, 1))
    good = F.get(parts, 2) == base64url(F.unhex(hmac_sha256_hex(body, key)))
    claims = from_base64url(F.get(parts, 1)).cast("string")
    return F.when(F.coalesce(F.size(parts) != 3, F.lit(True)), "malformed").when(~F.coalesce(good, F.lit(False)), "invalid").otherwise(token_state(claims, now, skew))


def random_token() -> Column:
    """64 hex digits that are new for every row and run."""
    return F.sha2(F.concat(F.uuid(), F.uuid()), 256)
