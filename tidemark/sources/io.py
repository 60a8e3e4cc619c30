"""Sources and sinks: Parquet tables in, append, export, dead letters and metric exposition out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """SRC1: a table, with only the asked columns read."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


#: rows of a task after a shuffle of a large table
TASK_ROWS = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` so that a task gets about ``TASK_ROWS`` of its ``rows``; as it is, where the session's partitions do."""
    parts = -(-rows // TASK_ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def leads(spark: SparkSession, folder: str) -> DataFrame:
    """The customer table in the shape of scored channels."""
    c = F.col("c_acctbal")
    tier = F.when(c >= 7500, "P0").when(c >= 5000, "P1").when(c >= 2500, "P2")
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("channel"), F.col("c_nationkey").alias("nation"), F.floor(c / 100).cast("int").alias("lead_score"), F.col("c_mktsegment").alias("segment"), tier.alias("tier"))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and their lines as directed events customer -> supplier."""
    o = table(spark, folder, "orders", ["o_orderkey", "o_custkey"])
    item = table(spark, folder, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_shipdate"])
    # both sides are dealt alike, so the tasks of the join do not grow with the tables
    n = item.count()
    o, item = spread(o, n, "o_orderkey"), spread(item, n, "l_orderkey")
    j = o.join(item, o.o_orderkey == item.l_orderkey)
    return j.select(F.col("o_custkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("relation"), F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").cast("int").alias("confidence"), F.col("l_linestatus").alias("evidence"))


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder's name under ``spark.checkpoint.dir``. A local one stands in only for a local master without that setting."""
    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not folder and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(folder or '/tmp/checkpoints').rstrip('/')}/tidemark-{tag}-{uuid.uuid4().hex}"


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: bytes of a batch that Python workers get
BATCH_CONF, DEFAULT_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "16777216b"


def bound_batches(spark: SparkSession) -> None:
    """Bound the batches of Python workers where the session has Spark's default, which holds 10,000 rows of any length up to 64 MB."""
    if spark.conf.get(BATCH_CONF) == DEFAULT_BATCH:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


def append(df: DataFrame, path: str) -> None:
    """SNK4: append-only snapshots."""
    df.write.mode("append").parquet(path)


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """SNK3: CSV with a header, or JSON lines."""
    (df.write.option("header", True).csv if kind == "csv" else df.write.json)(path)


def dead_letters(df: DataFrame, payload: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """SNK7: (parsed rows, rows whose payload is not JSON of that schema)."""
    parsed = df.withColumn("_p", F.from_json(payload, schema))
    bad = F.expr(f"{payload} is not null and try_parse_json({payload}) is null") | F.col(payload).isNull()
    return parsed.filter(~bad).select(*df.columns, "_p.*"), df.filter(bad)


def envelopes(df: DataFrame, payload: str, schema: str, source: str, at: str) -> DataFrame:
    """SNK7: the rows of ``df`` whose payload does not parse, each as an audit envelope: source, reason, payload, its length and digest, and when it was seen.

    A payload that is null, no JSON, or JSON but no object is dead; a field that does not fit
    the schema makes it dead too, a field that is absent does not.
    """
    text = F.col(payload)
    parsed = F.try_parse_json(payload)
    fields = F.from_json(payload, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    reason = (
        F.when(text.isNull(), "missing").when(parsed.isNull(), "no JSON").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "no object").when(fields["_bad"].isNotNull(), "does not fit the schema")
    )
    rows = df.withColumn("reason", reason).filter("reason is not null")
    return rows.select(F.lit(source).alias("source"), "reason", text.alias("payload"), F.length(payload).alias("length"), F.sha2(payload, 256).alias("digest"), F.col(at).alias("seen_at"))


def exposition(name: str, label: str, key: Column, value: Column) -> Column:
    """SNK6: one gauge in text form."""
    return F.format_string(f'{name}{{{label}="%s"}} %d', key, value)
