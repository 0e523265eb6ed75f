"""Reproducible draws and content keys.

A draw depends only on (seed, replicate, identifier), never on partitioning, so
the same numbers come out on any cluster and after any task retry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_int(seed: int, *parts: Column) -> Column:
    """A 32-bit integer from md5(seed|part|part...)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def draw_unit(seed: int, *parts: Column) -> Column:
    """A number in [0, 1)."""
    return draw_int(seed, *parts) / F.lit(4294967296.0)


def sql_draw_int(seed: int, *parts: str) -> str:
    """The same draw for a SQL oracle."""
    text = " || '|' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"


def hash_key(*cols: Column) -> Column:
    """sha256 of the canonical JSON of the columns."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)
