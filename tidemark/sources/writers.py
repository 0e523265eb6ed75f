"""Writers and export guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import finite


def to_long(wide: DataFrame, *, ids: list[str], values: list[str], item: str = "item", value: str = "value") -> DataFrame:
    return wide.select(*ids, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(ids, values, item, value)


def write_parquet_long_wide(wide: DataFrame, folder: str, *, ids: list[str], values: list[str]) -> None:
    """One wide and one long table."""
    wide.write.mode("errorifexists").parquet(f"{folder}/wide")
    to_long(wide, ids=ids, values=values).write.mode("errorifexists").parquet(f"{folder}/long")


def write_task_splits(task: DataFrame, folder: str, *, label: str = "label", split: str = "split", unsealed: bool = False) -> None:
    """trainval with labels; test features and test labels apart; holdout only when unsealed."""
    trainval = task.where(F.col(split).isin("train", "val"))
    trainval.write.partitionBy(split).parquet(f"{folder}/trainval")
    test = task.where(F.col(split) == "test")
    test.drop(label, split).write.parquet(f"{folder}/test_features")
    test.select("row_id", label).write.parquet(f"{folder}/test_labels")
    if unsealed:
        task.where(F.col(split) == "holdout").drop(split).write.parquet(f"{folder}/holdout")


def write_aggregates_only(df: DataFrame, path: str, *, allowed: list[str], entity_columns: tuple[str, ...] = ("entity", "row_id")) -> None:
    """Export only listed columns; refuse a frame that still carries entity-level columns."""
    bad = [c for c in df.columns if c in entity_columns or c not in allowed]
    if bad:
        raise ValueError(f"columns not allowed in an aggregate export: {bad}")
    df.write.option("header", "true").csv(path)


def json_safe(df: DataFrame) -> DataFrame:
    """Non-finite numbers become NULL at any depth, so the JSON is strict."""

    def fix(c, t):
        if isinstance(t, (T.DoubleType, T.FloatType)):
            return finite(c)
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: fix(x, t.elementType))
        if isinstance(t, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[fix(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
        if isinstance(t, T.MapType):
            return F.transform_values(c, lambda _, v: fix(v, t.valueType))
        return c

    return df.select(*[fix(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def json_safe_export(df: DataFrame, out: str = "json") -> DataFrame:
    safe = json_safe(df)
    body = F.struct(*[F.col(f"`{c}`") for c in safe.columns])
    return safe.select(F.to_json(body, {"ignoreNullFields": "false"}).alias(out))


def table_inventory(tables: dict[str, tuple[DataFrame, list[str], str | None]]) -> DataFrame:
    """Rows, columns, keys, distinct keys and time range per table: one small row each."""
    parts = []
    for name, (df, keys, time) in tables.items():
        parts.append(
            df.agg(
                F.count(F.lit(1)).alias("n_rows"),
                F.count_distinct(*keys).alias("n_keys"),
                (F.min(time).cast("string") if time else F.lit(None).cast("string")).alias("t_min"),
                (F.max(time).cast("string") if time else F.lit(None).cast("string")).alias("t_max"),
            ).select(F.lit(name).alias("table_name"), F.lit(len(df.columns)).alias("n_columns"), F.lit(",".join(keys)).alias("key_columns"), "*")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
