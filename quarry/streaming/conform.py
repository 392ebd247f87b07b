"""Incremental load with the same conformance rules (SURVEY §2.4 dq_conform,
§2.1 snk_orc_partitioned) as a Structured Streaming job.

The reference has no streaming operator; the rules and the partitioned sink
are plain Column expressions and writers, so they apply unchanged to a
streaming DataFrame.  Conforming rows go to Spark's file sink, which is
exactly-once through its own commit log; the violation report is a
watermarked event-time aggregate, emitted once a window is final.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.quality import any_fail, conform


def conform_stream(stream: DataFrame, rules: Mapping[str, Column], path: str, checkpoint: str,
                   partition_by: Sequence[str] = (), fmt: str = "orc",
                   available_now: bool = True) -> StreamingQuery:
    """Append the rows passing every rule to a (partitioned) table as they arrive."""
    w = (conform(stream, rules).writeStream.format(fmt).outputMode("append")
         .option("checkpointLocation", checkpoint).option("path", path))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def violation_stream(stream: DataFrame, rules: Mapping[str, Column], event_time: str,
                     window: str = "1 day", by: Sequence[str] = (), delay: str = "1 day") -> DataFrame:
    """Per event-time window (and group): rows, violations, percent.  Late rows within
    ``delay`` are still counted; state older than the watermark is dropped."""
    bad = any_fail(rules)
    # watermarks need TIMESTAMP; a wall-clock TIMESTAMP_NTZ is read in the session zone
    if stream.schema[event_time].dataType.typeName() == "timestamp_ntz":
        stream = stream.withColumn("_event_ts", F.col(event_time).cast("timestamp"))
        event_time = "_event_ts"
    return (stream.withWatermark(event_time, delay)
            .groupBy(F.window(event_time, window).alias("window"), *by)
            .agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(bad, 1)).alias("violations"))
            .withColumn("pct", F.round(100.0 * F.col("violations") / F.col("rows"), 3)))
