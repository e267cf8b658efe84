"""Keyed masking of personal data: HMAC-SHA256 in hex, null for null."""

from __future__ import annotations

import hashlib
import hmac
import logging

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def pads(key: bytes) -> tuple[str, str]:
    """Hex of the inner and outer padded keys."""
    key = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def mask_native(value: Column, key: bytes) -> Column:
    """JVM-side HMAC. The plan shows literals from which the key follows: for synthetic keys only."""
    inner, outer = (F.unhex(F.lit(p)) for p in pads(key))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def mask_arrow(value: Column, key: bytes) -> Column:
    """Arrow-batched HMAC: the key travels in the function, not in the plan."""

    @F.arrow_udf("string")
    def mask(values):
        import pyarrow as pa

        return pa.array([None if v is None else hmac.new(key, v.encode(), hashlib.sha256).hexdigest() for v in values.to_pylist()], pa.string())

    return mask(value)


class MaskingError(ValueError):
    """There is no masking key and masking was not turned off."""


def masker(key: str | None, mode: str = "on", native: bool = False):
    """The masking function of a configuration. Without a key it fails, unless ``mode`` is ``off``, which warns."""
    if mode == "off":
        for _ in range(3):
            logging.getLogger(__name__).warning("masking is OFF: personal data will be written in clear")
        return lambda value: value
    if not key:
        raise MaskingError("a masking key is required")
    return lambda value: (mask_native if native else mask_arrow)(value, key.encode())
