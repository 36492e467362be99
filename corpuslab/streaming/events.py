"""Event-time windows over a stream of event files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.session import shared_dir

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, table: str = "events", files_per_trigger: int = 1) -> DataFrame:
    """The event table of a folder as a stream, one file or a folder of part files; ``ts`` becomes a timestamp, as watermarks ask for."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}.parquet")
    parts = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger)
    rows = source.parquet(f"{folder}/{table}.parquet") if parts else source.option("pathGlobFilter", f"{table}.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Number and sum by hour and type; rows later than the watermark are dropped."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type")
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def drained(stream: DataFrame, mode: str = "complete", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there, and return its result table, which is written to the shared folder batch by
    batch: of ``complete`` mode the last batch, of ``update`` mode the last row of each key. A batch that is repeated
    replaces itself."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/drained-{uuid.uuid4().hex}"
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/_batch={number}")
        last[:] = [number]

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{folder}/table/_batch={last[0]}")
    changes = spark.read.parquet(f"{folder}/table")
    rows = changes.groupBy(*(keys or [])).agg(F.max_by(F.struct(*stream.columns), "_batch").alias("_row")) if keys else changes.select(F.struct(*stream.columns).alias("_row"))
    return rows.select("_row.*")
