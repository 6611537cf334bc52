"""Audit of documents as they land in a folder, and first sight of addresses in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.operators.audit import audit
from inkloom.operators.lines import to_lines


def audit_landing(spark: SparkSession, landing: str, out: str, checkpoint: str, schema: str = "doc_id bigint, text string"):
    """Audits what has landed since the last run and appends the findings, then stops; runs may be repeated."""
    docs = spark.readStream.schema(schema).parquet(landing)

    def each(batch: DataFrame, batch_id: int) -> None:
        found = audit(to_lines(batch, "doc_id"))
        found.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(out)
        found.release()

    query = docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def first_sight(urls: DataFrame, column: str = "url", late: str = "1 day", time: str = "ts") -> DataFrame:
    """Each address once within the watermark: what a cache of fetched addresses is to a batch."""
    return urls.withWatermark(time, late).dropDuplicatesWithinWatermark([column])
