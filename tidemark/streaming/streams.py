"""Structured Streaming forms: time windows, marks and dedup, each run to the end of its input."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.sources.io import envelopes


def events(spark: SparkSession, folder: str, glob: str = "events.parquet", files_per_trigger: int = 1) -> DataFrame:
    """SRC6: the event table as a stream, with an event time in the session's zone."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """ST5: tumbling hours with a watermark."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("bucket"), "event_type", "n")


def high_water(stream: DataFrame) -> DataFrame:
    """ST1: the highest message id of each channel so far (monotone)."""
    return stream.groupBy("user_id").agg(F.max("event_id").alias("mark"), F.count("*").alias("n"))


def first_seen(stream: DataFrame, key: str, ttl: str = "1 day") -> DataFrame:
    """ST8: a key passes once within its time to live."""
    return stream.withWatermark("ts", ttl).dropDuplicatesWithinWatermark([key])


def run_to_end(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Drain the available input into an in-memory table (tests and small jobs)."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def to_parquet(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain the available input into a Parquet table and read it.

    In ``append`` rows come as they are final, in ``complete`` the whole result anew, in
    ``update`` the rows of each batch, with its number in the column ``batch``.

    Nothing passes the driver. A batch that is run again after a failure writes to the same
    place: ``append`` by the sink's own log, the others by a folder named after the batch.
    """
    spark, sink = df.sparkSession, df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        sink.format("parquet").start(path).awaitTermination()
        return spark.read.parquet(path)
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        last.append(number)

    sink.foreachBatch(write).start().awaitTermination()
    if mode == "update":
        return spark.read.schema(StructType(df.schema.fields + [StructField("batch", LongType())])).parquet(path)
    return spark.read.parquet(f"{path}/batch={last[-1]}") if last else spark.createDataFrame([], df.schema)


def split_dead_letters(df: DataFrame, payload: str, schema: str, source: str, at: str, folder: str) -> dict[str, int]:
    """SNK7 as a stream: each batch goes to two Parquet sinks under ``folder``, ``good`` (parsed) and ``dead`` (envelopes).

    A batch is written to folders of its number, so a batch that is run again adds nothing. Returns
    the counts of all batches of this run, observed while they were written: good, dead and all.
    """
    counts = {"good": 0, "dead": 0, "all": 0}

    def write(batch: DataFrame, number: int) -> None:
        dead = envelopes(batch, payload, schema, source, at)
        good = batch.filter(F.coalesce(F.schema_of_variant(F.try_parse_json(payload)).startswith("OBJECT"), F.lit(False)))
        good = good.withColumn("fields_", F.from_json(payload, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})).filter("fields_._bad is null")
        good = good.select(*df.columns, F.struct(*[F.col(f"fields_.{f.name}").alias(f.name) for f in good.schema["fields_"].dataType if f.name != "_bad"]).alias("fields"))
        seen = {}
        for name, rows in (("good", good), ("dead", dead)):
            seen[name] = Observation()
            rows.observe(seen[name], F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
            counts[name] += seen[name].get["n"]
        counts["all"] += batch.count()

    df.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return counts
