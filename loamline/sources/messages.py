"""Broker messages as streams: a Kafka topic, or files of the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MESSAGE_SCHEMA = ("key binary, value binary, topic string, partition int, offset bigint, "
                  "timestamp timestamp")


def read_kafka(spark: SparkSession, servers: str, topic: str, starting: str = "latest",
               max_per_trigger: int | None = None, allow_loss: bool = False, **options: str) -> DataFrame:
    """One topic as a stream. A rate limit, and going on after offsets were lost to retention, are
    choices of the caller."""
    reader = spark.readStream.format("kafka").options(**{
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        "failOnDataLoss": str(not allow_loss).lower(),
        **({"maxOffsetsPerTrigger": str(max_per_trigger)} if max_per_trigger else {}),
        **options,
    })
    return reader.load()


def read_message_files(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The same columns from a folder of Parquet files."""
    return (spark.readStream.schema(MESSAGE_SCHEMA)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def write_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    """Send (key, value) rows to a topic, e.g. dead letters."""
    (messages.select("key", "value").write.format("kafka")
     .option("kafka.bootstrap.servers", servers).option("topic", topic).save())
