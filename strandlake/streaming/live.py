"""Live runs: files that arrive in a folder, counted as they come.

A file source lists the folder; rows that were seen are dropped by identity; counts are
additive, so a running aggregate equals the batch one. A file whose name starts with
``final_summary_`` says that no more will come: then one last pass takes what is left.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlake.session import read_texts, work_dir, write_text

#: Name of the file that ends a run, and seconds between looks.
SENTINEL, POLL = "final_summary_", 0.1


def distinct(rows: DataFrame, identity: list[str], at: str | None = None, delay: str | None = None) -> DataFrame:
    """Rows once by ``identity``. With a ``delay`` a live run forgets identities that lie further behind the latest time in ``at``: its
    state is as large as what comes within the delay, a repeat within it is dropped, and rows older than it are late and dropped too.
    """
    return rows.dropDuplicates(identity) if delay is None else rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(identity)


def running_counts(events: DataFrame, delay: str | None = None) -> DataFrame:
    """day, event_type, n, high over distinct events; with a ``delay`` in bounded state."""
    once = distinct(events, ["event_id"], "ts", delay)
    return once.groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") > 50).cast("long")).alias("high"))


def source(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder (whatever else lies there), or the one file a path names."""
    reader = spark.readStream.schema(schema)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        reader, path = reader.option("pathGlobFilter", p.getName()), p.getParent().toString()
    else:
        reader = reader.option("pathGlobFilter", "*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def running_counts_to_table(spark: SparkSession, path: str) -> DataFrame:
    """Runs the stream over what is there and returns its last complete result."""
    name = f"{work_dir(spark)}/strandlake/stream-{uuid.uuid4().hex}"
    schema = spark.read.option("pathGlobFilter", "*.parquet").parquet(path).schema
    stream = running_counts(source(spark, path, schema))
    out = f"{name}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")

    q = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{name}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    last = q.lastProgress["batchId"] if q.lastProgress else 0
    return spark.read.schema("day string, event_type string, n long, high long").parquet(f"{out}/{last}")


def per_site_counts(calls: DataFrame, threshold: float = 0.8, at: str | None = None, delay: str | None = None) -> DataFrame:
    """Running form of the thresholded site counts over a stream of read-level winners: chrm, pos, strand, winner, win_lp."""
    sure = F.exp("win_lp") > threshold
    return distinct(calls, ["chrm", "pos", "strand", "read_id"], at, delay).groupBy("chrm", "pos", "strand").agg(F.count(F.lit(1)).alias("reads"), F.sum(sure.cast("long")).alias("valid_reads"), F.sum((sure & (F.col("winner") != "can")).cast("long")).alias("n_mod"))


def until_sentinel(spark: SparkSession, folder: str, start, poll: float = POLL, most_seconds: float | None = None) -> None:
    """Keeps the query of ``start(trigger)`` going until the sentinel is in ``folder``, then runs it once more on what is left.

    ``start`` takes trigger options and returns a StreamingQuery on one checkpoint.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{SENTINEL}*")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    q: StreamingQuery = start({"processingTime": "1 second"})
    began = time.time()
    while not (found := fs.globStatus(path)) and (most_seconds is None or time.time() - began < most_seconds):
        if not q.isActive:
            raise RuntimeError(f"stream ended: {q.exception()}")
        time.sleep(poll)
    q.stop()
    start({"availableNow": True}).awaitTermination()
    del found


def limited(writer, most: int, identity: str = "read_id", state: str | None = None):
    """A foreachBatch function that hands at most ``most`` rows over all batches to ``writer``, in order of identity within one.

    ``state``: a folder in the shared store that keeps how many rows each batch gave, best within the stream's
    checkpoint. A run that starts again goes on from there, and a batch that is run again gives what it gave. Without it the count is this run's.
    """
    given: dict[int, int] = {}

    def before(spark: SparkSession, number: int) -> int:
        if state is None:
            return sum(n for k, n in given.items() if k < number)
        told = [json.loads(x) for x in read_texts(spark, state)]
        given.update({t["batch"]: t["rows"] for t in told})
        return sum(t["rows"] for t in told if t["batch"] < number)

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        left = most - before(spark, number)
        if left <= 0:
            return
        part = batch.orderBy(identity).limit(left).persist()
        n = part.count()
        writer(part, number)
        if state is not None and number not in given:
            write_text(spark, f"{state}/{number:012d}.json", json.dumps({"batch": number, "rows": n}))
        given[number] = n
        part.unpersist()

    return take
