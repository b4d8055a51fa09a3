"""Extension: link new query records as their files arrive.

Each micro-batch goes through the batch linkage against a fixed pool, and its
matches replace the partition of that batch, so a batch that is run again
after a failure leaves one copy.  Exclusivity holds within a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import linkage
from ..sources.records import write_partition


def link_stream(spark: SparkSession, path: str, schema: str, pool: DataFrame, out: str, checkpoint: str, tau: float = 0.5) -> StreamingQuery:
    """Link the Parquet files that appear below ``path`` (entity_id, name,
    address, country) until all that are there are done."""

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            write_partition(linkage.simple_link(rows, pool, tau).withColumn("batch", F.lit(number)), out, "batch")

    stream = spark.readStream.schema(schema).parquet(path)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
