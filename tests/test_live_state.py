import pytest
from pyspark.sql import functions as F

from strandlake.streaming import live, reporting


def feed(spark, folder, batches):
    """A file a batch; names in order, and times too, for the source takes old files first."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "event_id long, s long, event_type string, value double").withColumn("ts", F.timestamp_seconds("s"))
        df.coalesce(1).write.mode("append").parquet(str(folder))


def by_file(spark, folder, schema):
    return live.source(spark, str(folder), schema, 1)


def days(n, rows, repeat):
    """Batches a day apart; each repeats some rows of the one before."""
    out = []
    for b in range(n):
        own = [(b * rows + i, 1_700_000_000 + b * 86_400 + i, f"t{i % 3}", float(i % 100)) for i in range(rows)]
        out.append(own + (out[-1][:repeat] if out else []))
    return out


SCHEMA = "event_id long, s long, event_type string, value double, ts timestamp"


def test_state_stays_bounded_over_many_batches(spark, tmp_path):
    batches = days(10, 60, 20)
    held = {}
    for name, delay in (("bounded", "2 days"), ("unbounded", None)):
        folder, kept = tmp_path / name, {}
        states = []
        for rows in batches:
            feed(spark, folder, [rows])

            def keep(batch, number, kept=kept):
                kept["rows"] = sorted(map(tuple, batch.collect()))

            s = live.running_counts(live.source(spark, str(folder), spark.createDataFrame([], SCHEMA).schema), delay)
            q = s.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
            q.awaitTermination()
            states += [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"] if o["operatorName"] == "dedupeWithinWatermark" or o["operatorName"] == "dedupe"]
        held[name] = states
        every = spark.createDataFrame([r for b in batches for r in b], "event_id long, s long, event_type string, value double").withColumn("ts", F.timestamp_seconds("s"))
        assert kept["rows"] == sorted(map(tuple, live.running_counts(every).collect()))
    assert max(held["bounded"]) <= 5 * 60 < 10 * 60 == max(held["unbounded"])


def test_read_limit_outlives_a_restart(spark, tmp_path):
    folder, got = tmp_path / "in", []
    for k, rows in enumerate(days(4, 30, 0)):
        feed(spark, folder, [rows])
        # A new function each time, as a run has that starts again.
        take = live.limited(lambda part, number: got.extend(r["event_id"] for r in part.collect()), 70, "event_id", str(tmp_path / "given"))
        s = live.source(spark, str(folder), spark.createDataFrame([], SCHEMA).schema)
        s.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        assert len(got) == min(70, 30 * (k + 1))
    assert got == list(range(70))
    # A batch that is run again gives what it gave.
    again = []
    batch = spark.createDataFrame([(i,) for i in range(60, 90)], "event_id long")
    live.limited(lambda part, number: again.extend(r["event_id"] for r in part.collect()), 70, "event_id", str(tmp_path / "given"))(batch, 2)
    assert again == list(range(60, 70))


def rules_of_reads():
    return {"short": F.col("n") >= 10, "not mapped": F.col("chrm").isNotNull()}


READS = [("a", 5, None), ("b", 20, None), ("c", 30, "chr1"), ("d", None, "chr1"), ("e", 10, "chr2")]


def test_counts_of_a_run_equal_its_input(spark, tmp_path):
    rows = spark.createDataFrame(READS, "read_id string, n int, chrm string")
    counts = reporting.run(rows, rules_of_reads(), str(tmp_path / "good"), str(tmp_path / "bad"))
    assert counts == {"rows": 5, "good": 2, "short": 2, "not mapped": 1}
    good, bad = spark.read.parquet(str(tmp_path / "good")), spark.read.parquet(str(tmp_path / "bad"))
    assert sorted(map(tuple, good.collect())) == [READS[2], READS[4]] and good.columns == rows.columns
    assert sorted((r["read_id"], r["reason"]) for r in bad.collect()) == [("a", "short"), ("b", "not mapped"), ("d", "short")]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["bad", "good"]
    none = reporting.run(rows.limit(0), rules_of_reads(), str(tmp_path / "good0"), str(tmp_path / "bad0"))
    assert none == {"rows": 0, "good": 0, "short": 0, "not mapped": 0} and spark.read.parquet(str(tmp_path / "bad0")).count() == 0


def test_progress_of_a_live_run(spark, tmp_path):
    folder = tmp_path / "in"
    feed(spark, folder, days(3, 30, 5))
    rules = {"low": F.col("value") >= 10.0}
    log = reporting.ProgressLog("counted")
    spark.streams.addListener(log)
    try:
        s = reporting.mark(by_file(spark, folder, spark.createDataFrame([], SCHEMA).schema), rules).observe("reads", *reporting.counters(rules))
        q = s.writeStream.queryName("counted").format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert log.ended.wait(30) and log.error is None
    finally:
        spark.streams.removeListener(log)
    totals = log.totals()
    assert totals["rows"] == totals["observed_rows"] == 100 and totals["observed_good"] + totals["observed_rule_0"] == 100 and totals["observed_rule_0"] > 0
    assert len({b["batch"] for b in log.batches}) >= 3


def test_limit_without_state(spark):
    got = []
    take = live.limited(lambda part, number: got.extend(r["id"] for r in part.collect()), 7, "id")
    for number in range(3):
        take(spark.range(number * 5, number * 5 + 5), number)
    assert got == list(range(7))
    with pytest.raises(ZeroDivisionError):
        live.limited(lambda part, number: 1 / 0, 7, "id")(spark.range(3), 0)
