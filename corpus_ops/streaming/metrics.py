"""Metrics as a stream: a source that follows a JSON-lines file, and live tables over it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

FIELDS = "line_no long, step long, loss double, val_loss double, tokens_per_sec double, elapsed_s double"
_NAMES = [x.split()[0] for x in FIELDS.split(", ")][1:]


def read_from(path: str, line: int, end: int | None = None) -> tuple[list[tuple], int]:
    """The rows from a line on, and the next line to read. Blank lines count; one that can't be read, or has no end yet, is left for later."""
    rows: list[tuple] = []
    try:
        file = open(path, encoding="utf-8")
    except FileNotFoundError:
        return rows, line
    with file:
        for i, raw in enumerate(file):
            if i < line:
                continue
            if end is not None and i >= end:
                break
            if raw.strip():
                try:
                    value = json.loads(raw)
                except ValueError:
                    break
                rows.append((i, *(value.get(k) if k == "step" else None if value.get(k) is None else float(value[k]) for k in _NAMES)))
            line = i + 1
    return rows, line


class _Follower(SimpleDataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"line": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, line = read_from(self.path, start["line"])
        return iter(rows), {"line": line}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(read_from(self.path, start["line"], end["line"])[0])


class MetricsFile(DataSource):
    """``readStream.format("metrics_file").load(path)``: one small file of a run, read on the driver, by lines consumed."""

    @classmethod
    def name(cls) -> str:
        return "metrics_file"

    def schema(self) -> str:
        return FIELDS

    def simpleStreamReader(self, schema) -> _Follower:
        return _Follower(self.options["path"])


def follow(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(MetricsFile)
    return spark.readStream.format("metrics_file").option("path", path).load()


def lines_of(spark: SparkSession, folder: str) -> DataFrame:
    """Metric rows of a folder to which closed files are added: the way for many runs at once."""
    schema = "run_id string, worker_no int, line_no long, step long, loss double, val_loss double, tokens_per_sec long, elapsed_s double, logged_at timestamp_ntz, received_at timestamp_ntz"
    return spark.readStream.schema(schema).parquet(folder)


def once(rows: DataFrame, late: str = "7 days") -> DataFrame:
    """Each line once, though it may be received again within the time given."""
    timed = rows.withColumn("at", F.col("received_at").cast("timestamp")).withWatermark("at", late)
    return timed.dropDuplicatesWithinWatermark(["run_id", "worker_no", "line_no"])


def rates(rows: DataFrame, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """run_id, window, n_lines, mean_loss by the time of logging; later lines than the watermark are dropped."""
    timed = rows.where("not isnan(loss) or loss is null").withColumn("at", F.col("logged_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("run_id", F.window("at", width)).agg(F.count("*").alias("n_lines"), F.avg("loss").alias("mean_loss"))


def unseen_documents(rows: DataFrame) -> DataFrame:
    """Documents whose stripped text has not come before; the state is kept by key on the executors."""
    from ..functions.text import strip

    return rows.withColumn("key", F.sha2(strip(F.col("text")), 256)).dropDuplicates(["key"]).drop("key")


def push(rows: DataFrame, send: Callable[[list[dict]], None], checkpoint: str, every: str | None = None):
    """Starts a query that hands each batch's rows to send; with no interval it takes what is there and ends."""

    def batch(df: DataFrame, _: int) -> None:
        found = [r.asDict(recursive=True) for r in df.toLocalIterator()]
        if found:
            send(found)

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
