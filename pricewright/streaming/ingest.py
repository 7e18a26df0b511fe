"""Listings as a stream: each batch is upserted; repeats are dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pricewright.operators.catalog import LISTING, Catalog


def observations(spark: SparkSession, folder: str, late: str = "1 hour", files: int = 100) -> DataFrame:
    """New Parquet files of listings; the same listing at the same time counts once, also if it comes late."""
    rows = spark.readStream.schema(LISTING).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.withWatermark("scraped_at", late).dropDuplicatesWithinWatermark(["listing_id", "scraped_at"])


def ingest(rows: DataFrame, catalog: Catalog, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Upsert each batch. A batch that is run again writes the same observations, which the history holds once."""
    writer = rows.writeStream.foreachBatch(lambda batch, _: catalog.upsert(batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
