"""Event sink frame (A5, S7, S8): one JSON message per reputation update.

``kafka_frame`` builds the (key, value) frame that ``format("kafka")``
expects, in batch (``.write``) and streaming (``.writeStream``) alike.  The
timestamp is ISO-8601 with the fraction only when it is not zero; a null
timestamp stays in the message as JSON null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOPIC = "user_reputation_updates"


def iso_timestamp(ts: Column) -> Column:
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(ts, "SSSSSS")
    return F.when(ts.isNull(), F.lit(None)).otherwise(
        F.concat(base, F.when(frac == "000000", F.lit("")).otherwise(F.concat(F.lit("."), frac)))
    )


def payload(trace: DataFrame, user: str = "User_Id", value: str = "new_reputation", source: str = "Dataset_Source", ts: str = "Timestamp") -> Column:
    msg = F.struct(
        F.col(user).cast("string").alias("user_id"),
        F.col(value).alias("new_reputation"),
        F.col(source).alias("dataset_source"),
        iso_timestamp(F.col(ts)).alias("timestamp"),
    )
    return F.to_json(msg, {"ignoreNullFields": "false"})


def kafka_frame(trace: DataFrame, user: str = "User_Id") -> DataFrame:
    return trace.select(F.col(user).cast("string").alias("key"), payload(trace, user).alias("value"))


def write_kafka(frame: DataFrame, servers: str, topic: str = TOPIC):
    """Batch write to Kafka (needs the spark-sql-kafka connector on the classpath)."""
    return frame.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
