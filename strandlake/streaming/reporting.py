"""Progress and errors of a run: rows with a reason go to a side table, counts come with the run itself.

``mark`` gives each row the first rule that it fails, so a run reads its input once: ``Observation`` counts on the way, good rows
and rejected ones are two filters. A live run keeps the counts of its batches by a listener.
"""

from __future__ import annotations

import threading
import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

REASON = "reason"


def mark(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds reason: the first of ``rules`` (name to a condition of good rows) that a row fails; null for good ones. A condition that is null has failed."""
    out = F.lit(None).cast("string")
    for name, good in reversed(rules.items()):
        out = F.when(~F.coalesce(good, F.lit(False)), name).otherwise(out)
    return rows.withColumn(REASON, out)


def counters(rules: dict[str, Column]) -> list[Column]:
    """Aggregates of marked rows: rows, good, and one of each rule by its number."""
    hit = lambda name: F.coalesce(F.sum((F.col(REASON) == name).cast("long")), F.lit(0))
    return [F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col(REASON).isNull(), 1)).alias("good"), *[hit(n).alias(f"rule_{i}") for i, n in enumerate(rules)]]


def named(metrics: dict, rules: dict[str, Column]) -> dict[str, int]:
    """Counters under the names of their rules."""
    return {"rows": metrics["rows"], "good": metrics["good"]} | {name: metrics[f"rule_{i}"] for i, name in enumerate(rules)}


def reason_counts(marked: DataFrame) -> DataFrame:
    """reason ("good" for good rows) and number of rows, by commonness."""
    return marked.groupBy(F.coalesce(REASON, F.lit("good")).alias(REASON)).agg(F.count(F.lit(1)).alias("n"))


def run(rows: DataFrame, rules: dict[str, Column], good_path: str, rejected_path: str) -> dict[str, int]:
    """Write rows to one folder in one pass, split by whether they are good, and return the counts of that pass.

    ``good_path`` and ``rejected_path`` hold the two parts in the end. Rejected rows keep all their columns and the reason.
    """
    seen = Observation("run")
    marked = mark(rows, rules).observe(seen, *counters(rules)).withColumn("_good", F.col(REASON).isNull())
    both = f"{good_path}.both"
    marked.write.partitionBy("_good").parquet(both)
    counts = named(seen.get, rules)
    spark = rows.sparkSession
    # Each part moves as a whole; a part without rows is an empty table.
    for flag, target, drop in (("true", good_path, REASON), ("false", rejected_path, None)):
        schema = marked.drop("_good", drop).schema if drop else marked.drop("_good").schema
        there = counts["good"] if flag == "true" else counts["rows"] - counts["good"]
        source = spark.read.schema(schema).parquet(f"{both}/_good={flag}") if there else spark.createDataFrame([], schema)
        source.write.parquet(target)
    path = spark._jvm.org.apache.hadoop.fs.Path(both)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return counts


class ProgressLog(StreamingQueryListener):
    """Counts of a live run: rows in, rows a second, observed counters, and how it ended."""

    def __init__(self, name: str | None = None):
        self.name, self.batches, self.ended, self.error = name, [], threading.Event(), None
        self.began = time.time()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if self.name is None or p.name == self.name:
            observed = {k: row.asDict() for k, row in p.observedMetrics.items()}
            self.batches.append({"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "observed": observed})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.error = event.exception
        self.ended.set()

    def totals(self) -> dict[str, int]:
        """Rows of all batches, and the sums of what was observed; a batch that ran twice counts once, as it ran last."""
        last = {b["batch"]: b for b in self.batches}
        out = {"rows": sum(b["rows"] for b in last.values())}
        for b in last.values():
            for metrics in b["observed"].values():
                for k, v in metrics.items():
                    out[f"observed_{k}"] = out.get(f"observed_{k}", 0) + (v or 0)
        return out
