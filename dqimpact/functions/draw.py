"""Repeatable per-row draws.

Every random choice is a hash of (seed, purpose, column, row key).  It needs no shuffle and no
order, gives the same answer after a lost executor, and can be repeated in any SQL engine that
has md5.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 2**32


def _key_text(key: str | Sequence[str]) -> list[Column]:
    names = [key] if isinstance(key, str) else list(key)
    return [F.col(name).cast("string") for name in names]


def draw(key: str | Sequence[str], seed: int, purpose: str, column: str, suffix: str = "") -> Column:
    """A whole number in [0, 2**32) that depends only on the arguments and the row key."""
    parts = [F.lit(f"{seed}:{purpose}:{column}"), *_key_text(key)]
    if suffix:
        parts.append(F.lit(suffix))
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def share(drawn: Column) -> Column:
    """The draw as a fraction in [0, 1)."""
    return drawn / F.lit(float(SPAN))
