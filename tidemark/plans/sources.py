"""Section 2.1 queries: derived tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.periods import quarter_end, quarter_index
from tidemark.plans.bindings import CY, DE, SP, customer_ytd, daily_events, supplier_panel, table
from tidemark.plans.registry import query
from tidemark.session import scratch_path
from tidemark.sources import readers as RD
from tidemark.sources import writers as WR

HEADER = ["entity", "report_date", "ytd", "n", "note"]


def _caret_files(s, d):
    """The YTD panel as one ``^`` text folder per quarter, with a description row and missing marks."""
    p = customer_ytd(s, d)
    ytd = F.when(F.col("n") > 1, F.col("ytd").cast("decimal(20,2)").cast("string")).otherwise(F.lit(RD.MISSING))
    line = F.concat_ws("^", F.col("entity").cast("string"), F.date_format(quarter_end("q"), "yyyyMMdd"), ytd, F.col("n").cast("string"), F.lit('café "x"'))
    head = p.select("q").distinct().select("q", F.explode(F.array(F.lit("^".join(HEADER)), F.lit("id text^date^amount^count^free"))).alias("value"))
    path = scratch_path(s, "caret")
    p.select("q", line.alias("value")).unionByName(head).repartition("q").write.partitionBy("q").option("encoding", "ISO-8859-1").text(path)
    return path


CARET_SQL = f"""WITH {CY} SELECT entity, q AS file_q, CASE WHEN n > 1 THEN ytd END AS ytd, CAST(n AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS absent FROM cy"""


@query("read_caret_text", CARET_SQL, "ytd:2 n:0 absent:0")
def _(s, d):
    df = RD.read_caret_text(s, _caret_files(s, d), items=["ytd", "n", "absent"], ids=["entity"], entity="entity", header=HEADER)
    return df.select("entity", "file_q", "ytd", "n", "absent")


@query("read_filename_period", f"WITH {CY} SELECT q AS file_q, count(*) AS n_rows FROM cy GROUP BY q")
def _(s, d):
    df = RD.read_caret_text(s, _caret_files(s, d), items=["ytd"], ids=["entity", "report_date"], entity="entity", header=HEADER)
    df = df.withColumn("row_q", quarter_index(F.to_date("report_date", "yyyyMMdd")))
    return RD.check_file_period(df, file_period="file_q", row_period="row_q").groupBy("file_q").agg(F.count(F.lit(1)).alias("n_rows"))


@query("read_sdmx_xml", f"""WITH {DE} SELECT series, CAST(date AS VARCHAR) AS date, CAST(n >= 60 AS INT) AS valid,
  CASE WHEN n >= 60 AND date <= DATE '2024-01-20' THEN total END AS value FROM de""", "value:2")
def _(s, d):
    e = daily_events(s, d)
    obs = F.struct(
        F.col("date").cast("string").alias("_TIME_PERIOD"),
        F.when(F.col("n") >= 60, F.col("total").cast("decimal(20,2)").cast("string")).otherwise("-9999").alias("_OBS_VALUE"),
        F.when(F.col("n") >= 60, "A").otherwise("ND").alias("_OBS_STATUS"),
    )
    # one observation per series and day: a series is bounded by the calendar
    x = e.groupBy(F.col("series").alias("_SERIES_NAME")).agg(F.sort_array(F.collect_list(obs)).alias("Obs")).withColumn("_CURRENCY", F.lit("USD"))
    path = scratch_path(s, "sdmx")
    x.write.format("xml").option("rootTag", "DataSet").option("rowTag", "Series").save(path)
    return RD.read_sdmx_xml(s, path, wall="2024-01-20").select("series", F.col("date").cast("string"), F.col("valid").cast("int"), "value")


EVENT_SCHEMA = T.StructType([
    T.StructField("series", T.StringType()), T.StructField("date", T.DateType()), T.StructField("value", T.DoubleType()),
])


@query("read_csv_gz", f"WITH {DE} SELECT series, CAST(date AS VARCHAR) AS date, CASE WHEN n >= 60 THEN total END AS value FROM de", "value:2")
def _(s, d):
    e = daily_events(s, d).select("series", "date", F.when(F.col("n") >= 60, F.col("total").cast("decimal(20,2)").cast("string")).otherwise(".").alias("value"))
    path = scratch_path(s, "csvgz")
    e.write.option("header", "true").option("compression", "gzip").csv(path)
    return RD.read_csv_gz(s, path, EVENT_SCHEMA).select("series", F.col("date").cast("string"), "value")


@query("read_parquet_table", "SELECT l_suppkey, sum(l_quantity) AS qty, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey", "qty:0")
def _(s, d):
    df = RD.read_parquet_table(s, d, "lineitem", ["l_suppkey", "l_quantity", "l_returnflag"])
    return df.where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"))


@query("read_jsonl_ledger", f"WITH {DE} SELECT series, CAST(date AS VARCHAR) AS date, total AS value FROM de", "value:2")
def _(s, d):
    path = scratch_path(s, "jsonl")
    daily_events(s, d).select("series", "date", F.col("total").alias("value")).write.json(path)
    return RD.read_jsonl_ledger(s, path, EVENT_SCHEMA).select("series", F.col("date").cast("string"), "value")


@query("decode_base64_payload", "SELECT doc_id, length(text) AS n_decoded, md5(text) AS digest FROM documents")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    body = F.to_json(F.struct(F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "").alias("content")))
    wrapped = docs.select("doc_id", F.concat(F.lit("reply: "), body, F.lit(" end")).alias("payload"))
    return RD.decode_base64_payload(wrapped, text="payload").select(
        "doc_id", F.length("decoded").cast("long").alias("n_decoded"), F.md5("decoded").alias("digest"))


@query("write_parquet_long_wide", f"""WITH {SP} SELECT entity, q, 'flow' AS item, flow AS value FROM sp
UNION ALL SELECT entity, q, 'stock', stock FROM sp""", "value:4")
def _(s, d):
    path = scratch_path(s, "panel")
    WR.write_parquet_long_wide(supplier_panel(s, d), path, ids=["entity", "q"], values=["flow", "stock"])
    return s.read.parquet(f"{path}/long")


def _task(s, d):
    p = supplier_panel(s, d).withColumn("row_id", F.concat_ws("_", "entity", "q")).withColumn("label", F.col("flow"))
    sp = F.when(F.col("q") < 7992, "train").when(F.col("q") < 7996, "val").when(F.col("q") < 8004, "test").otherwise("holdout")
    return p.select("row_id", "label", F.col("stock").alias("s_stock"), sp.alias("split"))


@query("write_task_splits", f"""WITH {SP}, t AS (SELECT CASE WHEN q < 7992 THEN 'train' WHEN q < 7996 THEN 'val' WHEN q < 8004 THEN 'test' ELSE 'holdout' END AS split, flow FROM sp)
SELECT split AS part, count(*) AS n_rows, sum(CASE WHEN split <> 'test' THEN flow END) AS label_sum FROM t WHERE split IN ('train', 'val', 'test') GROUP BY split""", "label_sum:3")
def _(s, d):
    path = scratch_path(s, "task")
    WR.write_task_splits(_task(s, d), path)
    tv = s.read.parquet(f"{path}/trainval").groupBy(F.col("split").alias("part")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("label_sum"))
    te = s.read.parquet(f"{path}/test_features").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("test").alias("part"), "n_rows", F.lit(None).cast("double").alias("label_sum"))
    return tv.unionByName(te)


@query("write_aggregates_only", f"WITH {SP} SELECT q, count(*) AS n, avg(flow) AS mean_flow FROM sp GROUP BY q", "mean_flow:2")
def _(s, d):
    path = scratch_path(s, "agg")
    agg = supplier_panel(s, d).groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.avg("flow").alias("mean_flow"))
    WR.write_aggregates_only(agg, path, allowed=["q", "n", "mean_flow"])
    return s.read.schema("q int, n long, mean_flow double").option("header", "true").csv(path)


@query("json_safe_export", f"""WITH {SP} SELECT entity, q, CASE WHEN q % 4 = 1 THEN NULL WHEN q % 4 = 2 THEN NULL ELSE flow END AS x,
  (q % 4 IN (1, 2))::INT AS was_bad FROM sp""", "x:4")
def _(s, d):
    p = supplier_panel(s, d)
    x = F.when(F.col("q") % 4 == 1, F.lit(float("nan"))).when(F.col("q") % 4 == 2, F.lit(float("inf"))).otherwise(F.col("flow"))
    js = WR.json_safe_export(p.select("entity", "q", x.alias("x"), (F.col("q") % 4).isin(1, 2).cast("int").alias("was_bad")))
    return js.select(F.from_json("json", "entity long, q int, x double, was_bad int").alias("r")).select("r.*")


@query("table_inventory", """
SELECT 'orders' AS table_name, 6 AS n_columns, 'o_orderkey' AS key_columns, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys,
  strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS t_min, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS t_max FROM orders
UNION ALL SELECT 'lineitem', 11, 'l_orderkey,l_linenumber', count(*), count(DISTINCT (l_orderkey, l_linenumber)),
  strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S'), strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') FROM lineitem
UNION ALL SELECT 'customer', 5, 'c_custkey', count(*), count(DISTINCT c_custkey), NULL, NULL FROM customer""")
def _(s, d):
    return WR.table_inventory({
        "orders": (table(s, d, "orders"), ["o_orderkey"], "o_orderdate"),
        "lineitem": (table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate"),
        "customer": (table(s, d, "customer"), ["c_custkey"], None),
    })


def _nation_files(s, d, name):
    path = scratch_path(s, name)
    table(s, d, "nation").repartition("n_nationkey").select("n_nationkey", F.col("n_name").alias("value")).write.partitionBy("n_nationkey").text(path)
    m = RD.content_manifest(s, path)
    return m.withColumn("file", F.regexp_extract("path", r"n_nationkey=([0-9]+)", 1).cast("int"))


@query("content_manifest", """
SELECT n_nationkey AS file, v.round_no AS round_no, length(n_name) + 1 AS bytes, sha256(n_name || chr(10)) AS sha256, CAST(v.round_no = 2 AS INT) AS unchanged, 1 AS first_seen
FROM nation, (VALUES (1), (2)) v(round_no)""")
def _(s, d):
    a = _nation_files(s, d, "fetch1").withColumn("round_no", F.lit(1))
    b = _nation_files(s, d, "fetch2").withColumn("round_no", F.lit(2))
    m = RD.flag_unchanged(a.unionByName(b), name="file", fetched="round_no")
    return m.select("file", "round_no", "bytes", "sha256", F.col("unchanged").cast("int"), "first_seen")


@query("manifest_check", "SELECT n_nationkey AS file, sha256(n_name || chr(10)) AS want FROM nation")
def _(s, d):
    listed = table(s, d, "nation").select(F.col("n_nationkey").alias("file"), F.sha2(F.concat(F.col("n_name"), F.lit("\n")), 256).alias("sha256"))
    return RD.manifest_check(listed, _nation_files(s, d, "check"), name="file").select("file", "want")
