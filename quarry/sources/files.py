"""File sources and sinks.

Scratch output lives under the cluster's shared checkpoint folder
(``spark.checkpoint.dir``), never under a machine-local temp folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.session import ensure_checkpoint_dir

# Text tokens that mean "no value" in delimited files.
NULL_TOKENS = ("", "NA", "n/a")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/quarry-out/{name}-{uuid.uuid4().hex[:12]}"


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True,
             infer: bool = True, schema: StructType | str | None = None,
             null_value: str | None = None) -> DataFrame:
    """Header CSV.  ``infer`` costs one extra pass over the files; give ``schema`` at scale."""
    r = spark.read.option("header", header).option("sep", sep)
    if null_value is not None:
        r = r.option("nullValue", null_value)
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", infer)
    return r.csv(path)


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",",
                   skip: int = 0) -> DataFrame:
    """Header-less delimited text with a declared schema, dropping the first ``skip`` lines of each file.

    Spark has no skip-N option.  The first lines of a file sit in its first
    split (``_metadata.file_block_start = 0``), read in order by one task,
    so ``monotonically_increasing_id`` orders them.  The ``skip`` smallest ids
    per file (at most ``skip`` x files rows) are anti-joined away.
    Declared columns are read as text first so junk header lines do not fail
    the ANSI cast; they are cast after the skip.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    text_schema = StructType.fromDDL(", ".join(f"`{f.name}` string" for f in schema.fields))
    raw = (spark.read.option("header", False).option("sep", sep).schema(text_schema).csv(path)
           .select("*", F.col("_metadata.file_path").alias("_file"),
                   F.col("_metadata.file_block_start").alias("_block"))
           .withColumn("_mid", F.monotonically_increasing_id()))
    if skip > 0:
        from pyspark.sql.window import Window
        heads = (raw.where(F.col("_block") == 0)
                 .withColumn("_r", F.row_number().over(Window.partitionBy("_file").orderBy("_mid")))
                 .where(F.col("_r") <= skip).select("_file", "_mid"))
        raw = raw.join(heads, ["_file", "_mid"], "left_anti")
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def nullify(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS,
            cols: Sequence[str] | None = None) -> DataFrame:
    """Turn any of several text tokens into NULL on every (or the listed) string column."""
    cols = set(cols or [f.name for f in df.schema.fields if f.dataType.typeName() == "string"])
    toks = list(tokens)
    return df.select(*[F.when(F.trim(F.col(c)).isin(toks), F.lit(None)).otherwise(F.col(c)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def register(df: DataFrame, name: str) -> str:
    """Name a DataFrame for SQL; re-registering replaces the old plan."""
    df.createOrReplaceTempView(name)
    return name


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], fmt: str = "orc",
                      compression: str = "snappy", mode: str = "overwrite",
                      max_records_per_file: int | None = None) -> str:
    """Dynamic-partition overwrite: only the partitions present in ``df`` are replaced.

    Rows are clustered by the partition columns first, so each task writes
    few files instead of one per partition value it happens to see; adaptive
    execution splits a large partition value over several tasks.
    """
    w = (df.hint("rebalance", *by).write.mode(mode).format(fmt).partitionBy(*by)
         .option("compression", compression).option("partitionOverwriteMode", "dynamic"))
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    w.save(path)
    return path


def write_csv(df: DataFrame, path: str, null_value: str = "", header: bool = True,
              sep: str = ",", mode: str = "overwrite") -> str:
    (df.write.mode(mode).option("header", header).option("sep", sep)
     .option("nullValue", null_value).option("emptyValue", "").csv(path))
    return path
