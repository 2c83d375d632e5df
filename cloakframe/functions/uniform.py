"""Randomness as a function of seed, purpose and row key: the same however rows are dealt, and in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, tag: str, key: Column) -> Column:
    """A double in [0, 1): the first 52 bits of an MD5."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
