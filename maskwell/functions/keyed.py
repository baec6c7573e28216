"""Keyed hashing and stable identifiers inside code generation."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\x1f"


def hmac_hex(key: bytes, *parts: Column | str) -> Column:
    """HMAC-SHA256 of the parts joined by the unit separator, as hex."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    message = F.encode(F.concat_ws(SEP, *parts), "UTF-8")
    first = F.sha2(F.concat(F.lit(inner), message), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def hmac_int(key: bytes, *parts: Column | str) -> Column:
    """First 15 hex digits of the HMAC as a non-negative long."""
    return F.conv(F.substring(hmac_hex(key, *parts), 1, 15), 16, 10).cast("long")


def stable_id(prefix: str, *parts: Column | str, digits: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(SEP, *parts), 256), 1, digits))


def group_id(entity_type: Column | str, key: Column | str) -> Column:
    """``type:hash`` of a group key."""
    t = F.lower(F.col(entity_type) if isinstance(entity_type, str) else entity_type)
    return F.concat(t, F.lit(":"), F.substring(F.sha2(F.concat_ws(SEP, t, key), 256), 1, 12))
