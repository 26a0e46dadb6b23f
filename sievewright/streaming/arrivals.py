"""Rows of arriving snapshot files.  The batch operators apply to each micro-batch; state is bounded by a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import ensure_checkpoint_dir


def arriving(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """New parquet files of a folder, a bounded number in each micro-batch; of a single file, that file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())
    return reader.parquet(folder)


def first_arrivals(rows: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """Rows whose key did not arrive within the delay before; later copies of a key count as new again."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windowed_counts(rows: DataFrame, time: str, width: str, delay: str, keys: list[str]) -> DataFrame:
    """window_start, keys, n_rows of tumbling windows; rows later than the delay are left out."""
    counted = rows.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select(F.col("w.start").alias("window_start"), *keys, "n_rows")


def drained(result: DataFrame) -> DataFrame:
    """The whole result of a streaming aggregate after all files that are there, batch by batch; kept in the shared checkpoint folder."""
    spark = result.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    write = lambda rows, _: rows.write.mode("overwrite").parquet(f"{base}/rows")
    query = result.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{base}/rows")
