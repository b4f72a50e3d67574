"""Stable identifiers as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def stable_id(*parts: Column | str) -> Column:
    """SHA-256 over the parts, joined by U+001F; a null part counts as empty instead of vanishing."""
    return sha256(F.concat_ws(SEPARATOR, *(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """Version 5 UUID: SHA-1 over namespace and name, with version and variant set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    cut = lambda a, n: F.substring(digest, a, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))
