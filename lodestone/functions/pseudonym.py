"""Keyed pseudonyms: HMAC-SHA256 from the built-in hash, so no Python runs."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def pads(salt: str) -> tuple[str, str]:
    """Inner and outer key blocks of the HMAC, in hex."""
    key = salt.encode()
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = key.ljust(64, b"\0")
    return bytes(x ^ 0x36 for x in block).hex(), bytes(x ^ 0x5C for x in block).hex()


def pseudonym(value: Column, salt: str, prefix: str = "U", digits: int = 12) -> Column:
    """prefix and the first hex digits of HMAC-SHA256(salt, value); the salt comes from the caller, never from code."""
    if not salt:
        raise ValueError("a pseudonym needs a salt")
    inner, outer = pads(salt)
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(value, "UTF-8")), 256)
    whole = F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)
    return F.concat(F.lit(prefix), F.substring(whole, 1, digits))
