import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from strandlake.session import deal, discard, materialize, read_texts, write_text

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ALONE = """
from strandlake.session import discard, local_session, materialize, work_dir
spark = local_session("1")
assert not spark.sparkContext.getConf().get("spark.checkpoint.dir")
a = materialize(spark.range(5), "a")
b = materialize(a, "b")
assert work_dir(spark) == work_dir(spark) and a._strandlake_path.startswith(work_dir(spark)) and b._strandlake_path.startswith(work_dir(spark))
assert b.count() == 5
discard(a)
print("done")
"""


def test_tables_are_written_where_no_folder_is_set(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    out = subprocess.run([sys.executable, "-c", ALONE], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("done"), out.stderr[-2000:]


def test_small_files_are_whole_and_never_replaced(spark, tmp_path):
    assert read_texts(spark, str(tmp_path / "none")) == []
    write_text(spark, str(tmp_path / "b.json"), "two\nlines é")
    write_text(spark, str(tmp_path / "a.json"), "one")
    with pytest.raises(FileExistsError):
        write_text(spark, str(tmp_path / "a.json"), "other")
    assert read_texts(spark, str(tmp_path)) == ["one", "two\nlines é"]
    assert sorted(p.name for p in tmp_path.glob("*.tmp")) == []


def test_discard_removes_the_table(spark):
    a = materialize(spark.range(3), "t")
    path = a._strandlake_path.removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(path)
    discard(a)
    assert not os.path.isdir(path)


def test_dealt_rows_need_no_exchange_and_no_task_takes_many(spark):
    x = spark.range(4000).selectExpr("id % 1000 as a", "id as b")
    dealt = deal(x, "a", share=50)
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert dealt.rdd.getNumPartitions() == 80 and sum(sizes) == 4000 and max(sizes) < 200
    assert dealt.groupBy(F.spark_partition_id().alias("p"), "a").count().groupBy("a").count().where("count > 1").isEmpty()
    assert deal(x.limit(0), "a").count() == 0 and deal(x, "a", rows=10).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    plan = dealt.groupBy("a", "b").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("name", ["mod_calls", "var_calls"])
def test_calls_are_grouped_in_shares_of_a_bounded_size(spark, tmp_path, monkeypatch, name):
    """A file that one task would read whole is grouped in as many shares as its rows ask for."""
    from strandlake.sources import fixtures

    monkeypatch.setattr(fixtures, "deal", lambda df, *keys: deal(df, *keys, share=100))
    spark.range(3000).selectExpr("id as l_orderkey", "id % 7 as l_partkey", "'F' as l_linestatus", "0.05D as l_discount", "0.01D as l_tax").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = getattr(fixtures, name)(spark, str(tmp_path))
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 6000 and len(sizes) == 30 and max(sizes) < 400


@pytest.mark.parametrize("name", ["writer_bed_methyl", "writer_mod_vcf", "writer_wiggle", "writer_wiggle_files", "calibrate_density", "mods_estimated_threshold", "mods_global_threshold", "mods_llr_stats", "calibrate_density_cells"])
def test_queries_group_sites_and_reads_in_shares(spark, tmp_path, monkeypatch, name):
    """The query's stage of groupings by site and read has a task for each hundred rows here, though one task reads the file."""
    from strandlake.plans import catalog
    from strandlake.sources import fixtures

    monkeypatch.setattr(fixtures, "deal", lambda df, *keys: deal(df, *keys, share=100), raising=False)
    spark.range(3000).selectExpr("id as l_orderkey", "id % 7 as l_partkey", "if(id % 2 = 0, 'F', 'O') as l_linestatus", "0.01D * (id % 11) as l_discount", "0.01D * (id % 9) as l_tax").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    group = f"{name}-{tmp_path}"
    spark.sparkContext.setJobGroup(group, name)
    try:
        assert catalog.QUERIES[name](spark, str(tmp_path)).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert 30 in {s.numTasks for s in stages if s}
