"""Scripts that arrive as a stream.  The batch operators have no unbounded input; these keep counts up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def script_stream(spark: SparkSession, path: str) -> DataFrame:
    """Segments of parquet files as they come into a folder."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


def lines_by_window(script: DataFrame, at: str = "loaded_at", window: str = "1 day", late: str = "30 days") -> DataFrame:
    """(start, book_id, quotes, overrides) of windows of loading time; rows later than `late` are left out."""
    stamped = script.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    quote = F.col("kind") == "quote"
    counts = stamped.groupBy(F.window("_at", window).alias("w"), "book_id").agg(
        F.count_if(quote).alias("quotes"), F.count_if(quote & F.coalesce("tag_override", F.lit(False))).alias("overrides")
    )
    return counts.select(F.col("w.start").alias("start"), "book_id", "quotes", "overrides")


def first_deliveries(script: DataFrame, at: str = "loaded_at", late: str = "60 days") -> DataFrame:
    """A stream without rows delivered again within `late`: the natural key once."""
    return script.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark(["book_id", "n", "id"]).drop("_at")


def run_to_end(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, appended to a table; windows still open stay for the next run."""
    query = counts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
