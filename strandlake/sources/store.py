"""Stored per-read scores: a folder of clustered Parquet with manifests that commit it.

Layout: ``data/<commit>`` holds rows, clustered and sorted by position; ``contigs`` and ``mod_bases`` hold what they refer to;
``manifests/<n>.json`` is written last and once, so that a write which stopped half-way is not there for readers. Opening checks format, kind,
columns and what the manifests promise; adding checks rows against contigs and alphabet first.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.session import deal, discard, materialize, read_texts, write_text

#: Version of the layout.
FORMAT = 1
#: Columns by kind; what rows are clustered by comes first.
KINDS = {
    "mods": ("chrm string, pos long, strand int, read_id string, mod_base string, score double", ["chrm", "pos", "strand"]),
    "variants": ("chrm string, pos long, test_end long, ref_seq string, alt_seq string, var_name string, read_id string, strand int, score double", ["chrm", "pos"]),
}


class StoreError(ValueError):
    """A folder that is no finished store of this format, or rows that do not belong into one."""


def _schema(kind: str) -> T.StructType:
    if kind not in KINDS:
        raise StoreError(f"no such kind: {kind}")
    return T._parse_datatype_string(KINDS[kind][0])


def _described(schema: T.StructType) -> list[list[str]]:
    return [[f.name, f.dataType.simpleString()] for f in schema]


@dataclass(frozen=True)
class Store:
    """An opened store."""

    spark: SparkSession
    path: str
    kind: str
    manifests: tuple[dict, ...]

    @property
    def calls(self) -> DataFrame:
        """All committed rows."""
        schema = _schema(self.kind)
        parts = [f"{self.path}/data/{m['commit']}" for m in self.manifests if m["rows"]]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    @property
    def contigs(self) -> DataFrame:
        return self.spark.read.schema("chrm string, chrm_len long").parquet(f"{self.path}/contigs")

    @property
    def mod_bases(self) -> DataFrame:
        """mod_base, can_base, long_name; empty for variants."""
        return self.spark.read.schema("mod_base string, can_base string, long_name string").parquet(f"{self.path}/mod_bases")

    def alphabet(self) -> list[str]:
        """Modified bases in order; a store has a few."""
        return sorted(r["mod_base"] for r in self.mod_bases.select("mod_base").collect())

    def within(self, chrm: str, start: int, end: int) -> DataFrame:
        """Rows at positions [start, end) of a contig; both conditions reach the scan, whose row groups are sorted by them."""
        return self.calls.where((F.col("chrm") == chrm) & (F.col("pos") >= start) & (F.col("pos") < end))

    def at(self, chrm: str, pos: int, strand: int | None = None) -> DataFrame:
        """Rows of one site."""
        out = self.within(chrm, pos, pos + 1)
        return out if strand is None else out.where(F.col("strand") == strand)

    def sites(self) -> DataFrame:
        """Distinct places with their numbers of rows and reads."""
        by = KINDS[self.kind][1]
        return self.by_read().groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("read_id").alias("reads"))

    def by_read(self) -> DataFrame:
        """All committed rows, dealt out by place and read: what is grouped by these takes tasks of a bounded size, and a deep place many of them."""
        return deal(self.calls, *KINDS[self.kind][1], "read_id", rows=sum(m["rows"] for m in self.manifests))

    def reads(self) -> DataFrame:
        """read_id and a 64-bit key of it, which needs no order of reads."""
        return self.calls.select("read_id").distinct().withColumn("read_key", F.xxhash64("read_id"))


def create(spark: SparkSession, path: str, kind: str, contigs: DataFrame, mod_bases: DataFrame | None = None) -> Store:
    """An empty store. ``contigs``: chrm, chrm_len, names once each; ``mod_bases``: mod_base, can_base, long_name."""
    schema = _schema(kind)
    if read_texts(spark, f"{path}/manifests"):
        raise StoreError(f"{path} is a store already")
    if (kind == "mods") != (mod_bases is not None):
        raise StoreError("modified bases belong to stores of mods, and to no others")
    lengths = contigs.select("chrm", F.col("chrm_len").cast("long").alias("chrm_len"))
    if not lengths.groupBy("chrm").count().where("count > 1 or chrm is null").isEmpty():
        raise StoreError("contigs need names of their own")
    lengths.write.parquet(f"{path}/contigs")
    if mod_bases is not None:
        mod_bases.select("mod_base", "can_base", "long_name").write.parquet(f"{path}/mod_bases")
    commit(spark, path, 0, kind, schema, "", 0)
    return open_store(spark, path, kind)


def commit(spark: SparkSession, path: str, number: int, kind: str, schema: T.StructType, name: str, rows: int) -> None:
    """Write manifest ``number``; of two writers that add at once, one gets it and the other an error."""
    told = {"format": FORMAT, "kind": kind, "columns": _described(schema), "number": number, "commit": name, "rows": rows}
    write_text(spark, f"{path}/manifests/{number:08d}.json", json.dumps(told))


def open_store(spark: SparkSession, path: str, kind: str) -> Store:
    """Open a finished store; :class:`StoreError` for folders that are none, half-written, of another format, kind or columns."""
    try:
        told = [json.loads(x) for x in read_texts(spark, f"{path}/manifests")]
        numbers = [m["number"] for m in told]
    except (json.JSONDecodeError, KeyError, TypeError) as e:
        raise StoreError(f"{path} has manifests of another kind") from e
    if not told:
        raise StoreError(f"{path} holds no finished store")
    want = _described(_schema(kind))
    for m in told:
        if m.get("format") != FORMAT or m.get("kind") != kind or m.get("columns") != want:
            raise StoreError(f"{path}: manifest {m['number']} is of format {m.get('format')}, kind {m.get('kind')}")
    if numbers != list(range(len(told))):
        raise StoreError(f"{path} lacks a manifest: {numbers}")
    store = Store(spark, path, kind, tuple(told))
    for m in told:
        if m["rows"]:
            # Parquet's own columns, without those that the reader would make up.
            there = spark.read.parquet(f"{path}/data/{m['commit']}")
            if _described(there.schema) != want:
                raise StoreError(f"{path}: the rows of {m['commit']} have other columns: {there.dtypes}")
    return store


def misfits(store: Store, rows: DataFrame) -> DataFrame:
    """Rows with a reason why they do not belong into a store: unknown contig, position outside it, unknown modified base, no score."""
    reason = F.when(F.col("_len").isNull(), "unknown contig").when((F.col("pos") < 0) | (F.col("pos") >= F.col("_len")) | F.col("pos").isNull(), "outside its contig")
    x = rows.join(store.contigs.select("chrm", F.col("chrm_len").alias("_len")), "chrm", "left")
    if store.kind == "mods":
        known: Column = F.col("mod_base").isin(store.alphabet())
        reason = reason.when(F.col("mod_base").isNull() | ~known, "unknown modified base")
    reason = reason.when(F.col("score").isNull() | F.isnan("score") | (F.col("score") > 0), "no log-probability")
    return x.select(*rows.columns, reason.alias("reason")).where("reason is not null")


def add(store: Store, rows: DataFrame) -> Store:
    """Add rows in one commit and return the store with them; nothing is added if some row does not belong into it."""
    schema, by = _schema(store.kind), KINDS[store.kind][1]
    lacking = [f.name for f in schema if f.name not in rows.columns]
    if lacking:
        raise StoreError(f"rows lack {lacking}")
    # Rows are read three times: checked, sampled for their ranges, sorted. What they come from is worked out once.
    cast = materialize(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]), "store-rows")
    wrong = misfits(store, cast).groupBy("reason").count().collect()
    if wrong:
        discard(cast)
        raise StoreError("rows that do not belong here: " + ", ".join(f"{r['count']} {r['reason']}" for r in sorted(wrong)))
    name = uuid.uuid4().hex
    cast.repartitionByRange(*by).sortWithinPartitions(*by, "read_id").write.parquet(f"{store.path}/data/{name}")
    discard(cast)
    n = store.spark.read.parquet(f"{store.path}/data/{name}").count()
    commit(store.spark, store.path, len(store.manifests), store.kind, schema, name, n)
    return open_store(store.spark, store.path, store.kind)


def merge(stores: list[Store], path: str) -> Store:
    """A new store of the rows of several, which must agree on their contigs' lengths; alphabets are united, repeated rows keep the largest score."""
    first = stores[0]
    if len({s.kind for s in stores}) > 1:
        raise StoreError("stores of different kinds")
    lengths, bases = first.contigs, first.mod_bases if first.kind == "mods" else None
    for s in stores[1:]:
        lengths = lengths.unionByName(s.contigs)
        bases = bases.unionByName(s.mod_bases) if bases is not None else None
    lengths = lengths.distinct()
    differ = lengths.groupBy("chrm").count().where("count > 1").limit(5).collect()
    if differ:
        raise StoreError(f"contigs of different lengths: {[r['chrm'] for r in differ]}")
    if bases is not None:
        bases = bases.groupBy("mod_base").agg(F.min(F.struct("can_base", "long_name")).alias("x"), F.countDistinct("can_base").alias("kinds"))
        if not bases.where("kinds > 1").isEmpty():
            raise StoreError("a modified base of several canonical ones")
        bases = bases.select("mod_base", "x.*")
    rows = first.calls
    for s in stores[1:]:
        rows = rows.unionByName(s.calls)
    key = [c for c in rows.columns if c != "score"]
    out = create(first.spark, path, first.kind, lengths, bases)
    dealt = deal(rows, *KINDS[first.kind][1], "read_id", rows=sum(m["rows"] for s in stores for m in s.manifests))
    return add(out, dealt.groupBy(*key).agg(F.max("score").alias("score")))
