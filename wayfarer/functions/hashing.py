"""Fixed draws: the same on every run, cluster and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Draws are whole numbers below this.
DRAWS = 1 << 32


def draw(*keys: str | Column, seed: int = 42) -> Column:
    """A number from 0 to DRAWS - 1: the first 32 bits of the MD5 sum of the keys' text and the seed, joined by bars."""
    cols = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols, F.lit(str(seed)))), 1, 8), 16, 10).cast("long")


def draw_sql(*keys: str, seed: int = 42) -> str:
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"CAST(CAST('0x' || substr(md5(concat_ws('|', {text}, '{seed}')), 1, 8) AS UBIGINT) AS BIGINT)"
