"""Deterministic draws: hashes in place of a random number generator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int, *ids: Column | str) -> Column:
    """An integer below 2^32, the same for the same seed and ids in any engine with MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(seed: int, *ids: Column | str) -> Column:
    return draw(seed, *ids) / F.lit(4294967296.0)


def draw_sql(seed: int, *ids: str) -> str:
    """The same as DuckDB SQL."""
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'CAST({i} AS VARCHAR)' for i in ids)})), 1, 8) AS BIGINT)"
