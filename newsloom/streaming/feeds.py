"""Structured Streaming forms of the row-wise operators and of windowed reports over arriving items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import paragraphs


def read_parquet_feed(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 16) -> DataFrame:
    """A folder of parquet files as a stream, with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paragraph rows of a stream; stateless."""
    return docs.select(id_col, F.posexplode(paragraphs(text_col)).alias("ord", "paragraph"))


def arrivals(items: DataFrame, time_col: str = "arrived_at", late: str = "3 days", window: str = "1 day", by: str = "source") -> DataFrame:
    """Items by window and source; rows later than ``late`` behind the newest are left out, as their window is closed."""
    return items.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late).groupBy(F.window(time_col, window), by).agg(F.count("*").alias("n"))


def first_of_key(items: DataFrame, key: str, time_col: str = "arrived_at", late: str = "3 days") -> DataFrame:
    """Repeated rows of a key within the watermark removed; state is dropped once they can't arrive any more."""
    return items.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late).dropDuplicatesWithinWatermark([key])
