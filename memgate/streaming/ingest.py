"""Structured Streaming upserts: a stream of log files into a MemoryStore, idempotent by batch."""

from pyspark.sql import DataFrame, SparkSession

from memgate.operators.store import MemoryStore


def ops_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with seq, op and the record's columns."""
    return spark.readStream.schema(f"seq long, op string, {schema}").json(path)


def upsert(stream: DataFrame, store: MemoryStore, checkpoint: str):
    """Start the query. A batch that is replayed writes the same operations again, and the fold by seq makes that harmless."""

    def batch(frame: DataFrame, _: int) -> None:
        store.append(frame)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
