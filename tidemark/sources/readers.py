"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = "--------"


def _caret_columns(raw: DataFrame, header: list[str], items: list[str], ids: list[str], entity: str) -> DataFrame:
    """Keep data rows (numeric id), cast strictly, add NULL columns for absent items."""
    rows = raw.where(F.col(entity).rlike(r"^\s*[0-9]+\s*$"))
    blank = lambda c: F.nullif(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")), F.lit(MISSING))
    cols = [F.trim(F.col(entity)).cast("long").alias(entity)]
    cols += [F.trim(F.col(c)).alias(c) for c in ids if c != entity]
    for it in items:
        cols.append((blank(it).cast("double") if it in header else F.lit(None).cast("double")).alias(it))
    return rows.select(*cols)


def read_caret_text(spark: SparkSession, path: str, *, items: list[str], ids: list[str], entity: str, header: list[str]) -> DataFrame:
    """``^``-separated latin-1 text without quoting; ``--------`` and empty are NULL.

    ``header`` is the file's column list (the schema is never inferred).  A description row
    after the header is dropped because its id is not a number; wanted items that the file
    lacks become NULL columns; bad numbers fail under ANSI casts.  The period is taken from
    the file name: ``file_q``."""
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    raw = (
        spark.read.schema(schema)
        .option("sep", "^").option("quote", "").option("encoding", "ISO-8859-1")
        .option("header", "false").option("recursiveFileLookup", "true")
        .csv(path)
        .withColumn("file_q", F.regexp_extract(F.input_file_name(), r"q=([0-9]+)", 1).cast("int"))
    )
    return _caret_columns(raw, header, items, [*ids, "file_q"], entity).withColumn("file_q", F.col("file_q").cast("int"))


def read_caret_zip(spark: SparkSession, path: str, *, items: list[str], ids: list[str], entity: str, header: list[str]) -> DataFrame:
    """The same layout inside ZIP members, which are read side by side.  If ``ids`` names ``file_q``, it is the period in the archive's
    name, NULL where that has none."""
    from tidemark.sources.archives import zip_lines

    parts = F.split("line", r"\^")
    period = F.nullif(F.regexp_extract("file", r"q=([0-9]+)", 1), F.lit("")).cast("int").alias("file_q")
    raw = zip_lines(spark, path).select(*[F.get(parts, i).alias(h) for i, h in enumerate(header)], period)
    out = _caret_columns(raw, header, items, ids, entity)
    return out.withColumn("file_q", F.col("file_q").cast("int")) if "file_q" in ids else out


def check_file_period(df: DataFrame, *, file_period: str, row_period: str) -> DataFrame:
    """Fail when a row's date is not in the period named by its file."""
    ok = F.col(file_period).eqNullSafe(F.col(row_period))
    return df.where(F.when(ok, True).otherwise(F.raise_error(F.lit("row period differs from the file name")).cast("boolean")))


SDMX_SCHEMA = T.StructType([
    T.StructField("_SERIES_NAME", T.StringType()),
    T.StructField("_CURRENCY", T.StringType()),
    T.StructField("Obs", T.ArrayType(T.StructType([
        T.StructField("_TIME_PERIOD", T.StringType()),
        T.StructField("_OBS_VALUE", T.StringType()),
        T.StructField("_OBS_STATUS", T.StringType()),
    ]))),
])


def read_sdmx_xml(spark: SparkSession, path: str, *, statuses: tuple[str, ...] = ("A", "ND"), wall: str | None = None) -> DataFrame:
    """Series -> observations.  An unknown status fails; ``ND`` or -9999 is invalid; values after
    ``wall`` are never converted."""
    x = spark.read.format("xml").option("rowTag", "Series").schema(SDMX_SCHEMA).load(path)
    o = x.select(F.col("_SERIES_NAME").alias("series"), F.explode("Obs").alias("o"))
    st = F.col("o._OBS_STATUS")
    o = o.where(F.when(st.isin(*statuses), True).otherwise(F.raise_error(F.lit("unexpected observation status")).cast("boolean")))
    date = F.to_date(F.col("o._TIME_PERIOD"))
    valid = (st != "ND") & (F.col("o._OBS_VALUE") != "-9999")
    visible = F.lit(True) if wall is None else date <= F.to_date(F.lit(wall))
    return o.select("series", date.alias("date"), valid.alias("valid"), F.when(valid & visible, F.col("o._OBS_VALUE")).cast("double").alias("value"))


def read_csv_gz(spark: SparkSession, path: str, schema: T.StructType, sentinel: str = ".") -> DataFrame:
    """Gzip CSV files below one path, one sentinel for missing."""
    return spark.read.schema(schema).option("header", "true").option("nullValue", sentinel).csv(path)


def read_parquet_table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_jsonl_ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def decode_base64_payload(df: DataFrame, *, text: str, field: str = "content", out: str = "decoded") -> DataFrame:
    """Cut the JSON object out of a text and decode its base64 field."""
    obj = F.regexp_extract(F.col(text), r"(?s)(\{.*\})", 1)
    val = F.get_json_object(obj, f"$.{field}")
    return df.withColumn(out, F.decode(F.unbase64(val), "UTF-8"))


def content_manifest(spark: SparkSession, path: str) -> DataFrame:
    """sha256 and size of every file below a path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("seen"))


def flag_unchanged(manifest: DataFrame, *, name: str, fetched: str) -> DataFrame:
    """First-seen time of each content and whether it equals the previous fetch of the same name."""
    from pyspark.sql import Window

    w = Window.partitionBy(name).orderBy(fetched)
    first = Window.partitionBy(name, "sha256")
    return manifest.withColumn("unchanged", F.coalesce(F.col("sha256") == F.lag("sha256").over(w), F.lit(False))).withColumn(
        "first_seen", F.min(fetched).over(first)
    )


def manifest_check(manifest: DataFrame, files: DataFrame, *, name: str) -> DataFrame:
    """Refuse to continue when a listed file is absent or its hash differs."""
    j = manifest.select(name, F.col("sha256").alias("want")).join(files.select(name, F.col("sha256").alias("got")), name, "left")
    ok = F.col("want").eqNullSafe(F.col("got"))
    return j.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("manifest mismatch: "), F.col(name))).cast("boolean")))
