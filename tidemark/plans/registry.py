"""Named queries over the driver tables, each with its SQL oracle.

``query`` records a builder ``fn(spark, sf_dir) -> DataFrame``.  Doubles are rounded
the same way in the plan and in the oracle (``dbl='a:6 b:2'``), so a hash of the
values does not depend on the order in which partial sums were merged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _digits(spec: str) -> dict[str, int]:
    out = {}
    for item in spec.split():
        name, _, k = item.partition(":")
        out[name] = int(k or 6)
    return out


def query(name: str, oracle: str | None = None, dbl: str = ""):
    digits = _digits(dbl)

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            cols = []
            for f in df.schema.fields:
                c = F.col(f"`{f.name}`")
                if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                    c = (F.round(c, digits.get(f.name, 6)) + F.lit(0.0)).alias(f.name)
                cols.append(c)
            return df.select(*cols)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if oracle:
            body = oracle
            if digits:
                rep = ", ".join(f"round(CAST({c} AS DOUBLE), {k}) + 0e0 AS {c}" for c, k in digits.items())
                body = f"SELECT * REPLACE ({rep}) FROM ({oracle})"
            ORACLES[name] = body
        return fn

    return deco
