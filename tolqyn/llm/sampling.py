"""Bounded samples for fitting models."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_sample(rows: DataFrame, key: str, n: int, total: int, salt: int = 0) -> DataFrame:
    """The n rows of smallest key hash, out of about `total`. Rows beyond the hash that about 1.3 n rows stay below fall out before
    the ordering, so tasks send next to nothing beyond the sample, however many there are."""
    h = F.xxhash64(F.lit(salt), key)
    share = min(1.0, (1.3 * n + 100) / max(1, total))
    below = int(-(2**63) + share * 2.0**64) if share < 1 else 2**63 - 1
    return rows.where(h <= F.lit(below)).orderBy(h, key).limit(n)
