"""Keyed pseudonyms, computed by the JVM."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pads(key: bytes) -> tuple[bytes, bytes]:
    """The inner and outer key blocks of HMAC-SHA256 (RFC 2104)."""
    full = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in full), bytes(b ^ 0x5C for b in full)


def pseudonym(value: Column, key: bytes, digits: int = 12) -> Column:
    """``pseudo:`` and the first hex digits of the keyed hash; null stays null."""
    inner, outer = (F.lit(bytearray(p)) for p in pads(key))
    hashed = F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))
    return F.concat(F.lit("pseudo:"), F.substring(F.sha2(F.concat(outer, hashed), 256), 1, digits))


def subnet_pseudonym(address: Column, key: bytes, digits: int = 12) -> Column:
    """An IPv4 address with its /24 under a pseudonym and its last part as it is; anything else as ``pseudonym``."""
    net, host = F.regexp_extract(address, r"^((?:[0-9]{1,3}\.){3})[0-9]{1,3}$", 1), F.regexp_extract(address, r"^(?:[0-9]{1,3}\.){3}([0-9]{1,3})$", 1)
    return F.when(net != "", F.concat(pseudonym(F.concat(net, F.lit("0")), key, digits), F.lit("."), host)).otherwise(pseudonym(address, key, digits))


def reidentify(df: DataFrame, column: str, known: DataFrame, address: str, keys: list[bytes]) -> DataFrame:
    """``df`` with ``address``: which of the ``known`` ones each pseudonym stands for under any of the keys; null if none."""
    every = F.array_distinct(F.array(*[pseudonym(F.col(address), key) for key in keys]))
    index = known.select(address, F.explode(every).alias(column)).distinct()
    return df.join(index, column, "left")


def key_fingerprint(key: bytes) -> str:
    return hashlib.blake2b(key, digest_size=8).hexdigest()
