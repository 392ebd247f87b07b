"""The conformance rules on a streaming source match the batch result."""

import os

from pyspark.sql import functions as F

from quarry.operators.quality import conform
from quarry.plans.q_quality import trip_rules
from quarry.plans.standins import trips
from quarry.sources.tables import Tables
from quarry.streaming import conform_stream, violation_stream

from paths import SF_SMALL


def test_stream_matches_batch(spark, tmp_path):
    tr = trips(Tables(spark, SF_SMALL)).withColumn("mnth", F.month("pickup"))
    src = str(tmp_path / "src")
    tr.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(tr.schema).option("maxFilesPerTrigger", 1).parquet(src)

    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    q = conform_stream(stream, trip_rules(), out, ckpt, partition_by=["mnth"])
    q.awaitTermination(120)
    got = spark.read.orc(out).count()
    assert got == conform(tr, trip_rules()).count() and got > 0

    rep = violation_stream(spark.readStream.schema(tr.schema).parquet(src), trip_rules(), "pickup",
                           window="3650 days", by=["vendor"], delay="0 seconds")
    q2 = (rep.writeStream.format("memory").queryName("viol").outputMode("update")
          .option("checkpointLocation", str(tmp_path / "ckpt2")).start())
    q2.processAllAvailable()
    q2.stop()
    streamed = spark.sql("SELECT vendor, SUM(violations) AS v FROM viol GROUP BY vendor").collect()
    assert sum(r.v for r in streamed) > 0
    assert os.path.isdir(out)
