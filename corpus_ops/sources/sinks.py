"""Where results go: documents, manifests, token shards, generated text; and how they are read again."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_documents(docs: DataFrame, path: str, gzip_json: bool = False) -> None:
    """Kept documents with their order; JSON lines in gzip for exchange, Parquet otherwise."""
    (docs.write.mode("overwrite").json(path, compression="gzip") if gzip_json else docs.write.mode("overwrite").parquet(path))


def read_documents(spark: SparkSession, path: str, order: str = "rec_id") -> DataFrame:
    """The documents in the order in which they were kept."""
    return spark.read.parquet(path).orderBy(order)


def write_analysis(row: DataFrame, path: str) -> None:
    """One row, one file."""
    row.coalesce(1).write.mode("overwrite").json(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_shards(packed: DataFrame, path: str) -> None:
    """Rows (split, shard, ord, ids) as one folder for each shard."""
    packed.repartition("split", "shard").sortWithinPartitions("split", "shard", "ord").write.mode("overwrite").partitionBy("split", "shard").parquet(path)


def open_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """The shards of one split; others are pruned."""
    return spark.read.parquet(path).where(F.col("split") == split)


def write_generated(rows: DataFrame, path: str, provenance: dict) -> None:
    """Generated conversations as JSON lines, and where they came from beside them."""
    rows.write.mode("overwrite").json(os.path.join(path, "generated"))
    rows.sparkSession.createDataFrame([(json.dumps(provenance, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "source"))


def cached(spark: SparkSession, path: str) -> DataFrame | None:
    """A table written before under a content-addressed name, None if there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.parquet(path) if there else None
