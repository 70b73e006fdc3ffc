"""Session helpers: shared working folder, materialised tables, code shipping."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
_shipped: set[str] = set()
#: Working folder by application, where none is set.
_own_folder: dict[str, str] = {}


def local_session(cores: str = "*", app: str = "strandlake") -> SparkSession:
    """A local session for tests, the bench and examples."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver found it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="strandlake-")) / "strandlake_code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def work_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where unset, a fresh one a session under a local master, and an error on a cluster."""
    path = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if path:
        return path.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"{CHECKPOINT_KEY} is not set: intermediate tables need a folder that all executors share")
    # Spark does not let the setting be changed in a running session, so the folder is remembered here.
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="strandlake-checkpoint-")
    return _own_folder[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{work_dir(df.sparkSession)}/strandlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._strandlake_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table written by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_strandlake_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: it is written beside its place and moved there; an error if it is there already."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    target, beside = fs_path(path), fs_path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(beside, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    if fs.exists(target) or not fs.rename(beside, target):
        fs.delete(beside, False)
        raise FileExistsError(path)


def read_texts(spark: SparkSession, folder: str, suffix: str = ".json") -> list[str]:
    """The small files of a folder by name; none if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*{suffix}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(f.getPath().toString() for f in found) if found else []
    return [spark.read.text(n, wholetext=True).first()[0] for n in names]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_size(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """(rows, UTF-8 bytes of ``column``), in one pruned scan."""
    rows, size = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(column))).first()
    return rows, size or 0


#: Rows of a partition where rows are dealt out before they are grouped; each operator of the stage may hold them once.
SHARE_ROWS = 250_000


def deal(df: DataFrame, *keys: str, rows: int | None = None, share: int = SHARE_ROWS) -> DataFrame:
    """``df`` with rows of equal ``keys`` together, in as many partitions as leave about ``share`` of ``rows`` to each.

    Groupings and windows by these keys, with others or not, need no further exchange, so a grouping task's memory stays the same whatever
    the size of the table, of its files' splits, or of what Spark puts together after a shuffle. (From 201 partitions on, the task that writes rows sorts
    them first: it holds its split, or spills.) Rows are counted where not given: for tables that are read.
    """
    n = df.count() if rows is None else rows
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // share)), *keys)


def n_blocks(df: DataFrame, size: int, block_bytes: int = 8 << 20) -> int:
    """Blocks of about ``block_bytes``, and several to a shuffle partition, so that tasks even out."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(4 * parts, -(-size // block_bytes))


def remove_tree(path: str) -> None:
    if os.path.isdir(path):
        shutil.rmtree(path)
