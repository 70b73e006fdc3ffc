"""Interval joins, overlap islands and sequential overlap resolution.

Spark has no range-join strategy: a bare range predicate becomes a nested loop. Here bins have levels, each
STEP times as wide as the one below; an interval goes to the bins it touches at the lowest level that is as wide as itself, two
as a rule, and what may meet it looks at every level that occurs. All joins are equi-joins on (keys, level, bin)
and check their pairs again, so a hot bin is split by Spark's skew join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.operators.prefix import running, with_previous
from strandlake.session import ship

#: How much wider a level's bins are than those of the level below.
STEP = 8


def bins_of(start: Column, end: Column, width: int | Column) -> Column:
    """Bins that [start, end) touches."""
    last = F.greatest(F.floor((end - 1) / width), F.floor(start / width))
    return F.sequence(F.floor(start / width).cast("long"), last.cast("long"))


def level_of(start: Column, end: Column, width: int) -> Column:
    """The lowest level whose bins are as wide as the interval. Rounding may take one more or less, which costs a bin and loses none."""
    return F.greatest(F.ceil(F.log(F.greatest(end - start, F.lit(1)) / width) / float(np.log(STEP))), F.lit(0)).cast("int")


def _width(level: Column | int, width: int) -> Column:
    return F.floor(width * F.pow(F.lit(float(STEP)), F.lit(level) if isinstance(level, int) else level)).cast("long")


def _levels(df: DataFrame, start: str, end: str, width: int) -> list[int]:
    """Levels that occur: a dozen at most for lengths up to 10**12."""
    found = df.select(level_of(F.col(start), F.col(end), width).alias("x")).distinct().where("x is not null")
    return sorted(r["x"] for r in found.collect())


def _own_bins(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    x = df.withColumn("_level", level_of(F.col(start), F.col(end), width))
    return x.withColumn("_bin", F.explode(bins_of(F.col(start), F.col(end), _width(F.col("_level"), width))))


def points_in_intervals(intervals: DataFrame, points: DataFrame, keys: list[str], start: str, end: str, point: str, width: int = 128, how: str = "inner") -> DataFrame:
    """Pairs with start <= point < end. ``how``: inner, left_semi or left_anti (of intervals). ``width``: of the lowest level's bins."""
    left = _own_bins(intervals, start, end, width)
    levels = _levels(intervals, start, end, width)
    if how != "inner":
        points = points.select(*keys, point).distinct()
    at = F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>")
    right = points.withColumn("_level", F.explode(at)).withColumn("_bin", F.floor(F.col(point) / _width(F.col("_level"), width)).cast("long"))
    within = (F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))
    if how == "inner":
        return left.join(right, [*keys, "_level", "_bin"]).where(within).drop("_bin", "_level")
    there = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_level").alias("_l"), F.col("_bin").alias("_b"), F.col(point).alias("_p"))
    meet = (F.col("_level") == F.col("_l")) & (F.col("_bin") == F.col("_b")) & (F.col("_p") >= F.col(start)) & (F.col("_p") < F.col(end))
    for i, k in enumerate(keys):
        meet = meet & (F.col(k) == F.col(f"_k{i}"))
    hit = left.join(there, meet, "left_semi").select(*[F.col(c).alias(f"_h_{c}") for c in intervals.columns]).distinct()
    same = F.lit(True)
    for c in intervals.columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_h_{c}"))
    return intervals.join(hit, same, how)


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], width: int = 128, cols: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Pairs of overlapping half-open intervals. Columns of ``b`` get the prefix b_.

    A pair meets at the higher level of the two: there the wider one has its own bins and the other looks it up.
    """
    s, e = cols
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys])
    la, lb = _levels(a, s, e, width), _levels(b, s, e, width)
    meet = (F.col(s) < F.col(f"b_{e}")) & (F.col(f"b_{s}") < F.col(e))
    once = F.col("_bin") == F.floor(F.greatest(F.col(s), F.col(f"b_{s}")) / _width(F.col("_level"), width))

    def looking(df: DataFrame, start: str, end: str, levels: list[int], above: bool) -> DataFrame:
        own = level_of(F.col(start), F.col(end), width)
        at = F.filter(F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>"), lambda x: x > own if above else x >= own)
        x = df.withColumn("_level", F.explode(at))
        return x.withColumn("_bin", F.explode(bins_of(F.col(start), F.col(end), _width(F.col("_level"), width))))

    sides = [(_own_bins(a, s, e, width), looking(right, f"b_{s}", f"b_{e}", la, False))]
    if la and lb and lb[-1] > la[0]:
        sides.append((looking(a, s, e, lb, True), _own_bins(right, f"b_{s}", f"b_{e}", width)))
    out = None
    for x, y in sides:
        z = x.join(y, [*keys, "_level", "_bin"]).where(meet & once).drop("_bin", "_level")
        out = z if out is None else out.unionByName(z)
    return out


def band_pairs(a: DataFrame, keys: list[str], start: str, end: str, distance: int, identity: str) -> DataFrame:
    """Pairs of non-overlapping intervals of one table at most ``distance`` apart, the earlier first."""
    right = a.select(*keys, F.col(start).alias("b_start"), F.col(end).alias("b_end"), F.col(identity).alias("b_id"))
    width = max(16, distance)
    x = a.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(end) / width).cast("long"), F.floor((F.col(end) + distance) / width).cast("long"))))
    y = right.withColumn("_bin", F.floor(F.col("b_start") / width).cast("long"))
    near = (F.col("b_start") >= F.col(end)) & (F.col("b_start") - F.col(end) <= distance)
    return x.join(y, [*keys, "_bin"]).where(near).drop("_bin")


def islands(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int = 100_000) -> DataFrame:
    """Adds island: number of the run of overlapping intervals, within ``keys``.

    Stretches of ``width`` are scanned apart, so a long contig is many tasks.
    """
    stretch = F.floor(F.col(start) / width)
    order = [start, end]
    reach = running(rows, keys, order, stretch, {"_reach": F.col(end)}, "max")
    fresh = reach.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col(start) >= F.col("_reach")), 1).otherwise(0).cast("long")).drop("_reach")
    # Rows of one start and end are alike here, so the order among them does not matter, but those that open an island come first.
    counted = running(fresh, keys, [start, F.desc("_new"), end], stretch, {"_before": F.col("_new")})
    return counted.withColumn("island", F.col("_before") + F.col("_new")).drop("_new", "_before")


def best_of_islands(rows: DataFrame, keys: list[str], score: str, identity: str, start: str = "start", end: str = "end") -> DataFrame:
    """The likeliest row of each island; the first of equals (smallest identity) wins."""
    return islands(rows, keys, start, end).groupBy(*keys, "island").agg(F.max_by(identity, F.struct(score, -F.col(identity))).alias(identity), F.max(score).alias(score), F.count(F.lit(1)).alias("members"))


#: Positions of a stretch whose rows one task goes through in order.
STRETCH = 10_000


class Pass:
    """Rows of a stretch in order, each with the row that takes over from it: the first later one that begins beyond it or scores more.

    A survivor changes only by being taken over, so that from each row on the pass is known. The rows fall into runs
    of neighbours from which the pass ends with one and the same survivor; a run's last start and best score tell whether a
    survivor from before is taken over within it.
    """

    def __init__(self, table: pa.Table):
        self.rows = table.sort_by([(c, "ascending") for c in ("s", "e", "i", "q")])
        column = lambda c: self.rows.column(c).combine_chunks()
        self.start, self.end = column("s").to_numpy(zero_copy_only=False).astype(np.int64), column("e").to_numpy(zero_copy_only=False).astype(np.int64)
        self.score, self.bar = scores(column("q").to_pylist())
        n = len(self.start)
        up, above = np.full(n, n), []
        for k in range(n - 1, -1, -1):
            # A row that scores no more than this one is needed by none before it: this one is nearer.
            while above and self.score[above[-1]] <= self.score[k]:
                above.pop()
            if above and self.bar[k] < np.inf:
                up[k] = above[-1]
            above.append(k)
        beyond = np.maximum(np.searchsorted(self.start, self.end, "left"), np.arange(1, n + 1))
        self.next = np.minimum(up, beyond)
        self.exit = np.arange(n)
        for k in range(n - 1, -1, -1):
            if self.next[k] < n:
                self.exit[k] = self.exit[self.next[k]]

    def runs(self) -> list[dict]:
        first = np.flatnonzero(np.r_[True, self.exit[1:] != self.exit[:-1]])
        last = np.r_[first[1:], len(self.exit)] - 1
        best = np.maximum.reduceat(self.score, first)
        return [{"start": int(self.start[z]), "score": float(q), "exit": self.row(int(self.exit[a]))} for a, z, q in zip(first.tolist(), last.tolist(), best.tolist(), strict=True)]

    def row(self, k: int) -> dict:
        return {c: self.rows.column(c)[k].as_py() for c in ("s", "e", "i", "q")}

    def survivors(self, carried: dict | None, last: bool) -> tuple[list[dict], list[int]]:
        """Rows that stay for good once this stretch is done: those carried in, and places of its own."""
        n, entry, out = len(self.start), 0, []
        if carried is not None:
            bar = scores([carried["q"]])[1][0]
            more = np.flatnonzero(self.score > bar)
            entry = min(int(np.searchsorted(self.start, carried["e"], "left")), int(more[0]) if len(more) else n)
            if entry == n:
                return ([carried] if last else []), []
            if self.start[entry] >= carried["e"]:
                out.append(carried)
        kept, at = [], entry
        while self.next[at] < n:
            if self.start[self.next[at]] >= self.end[at]:
                kept.append(at)
            at = int(self.next[at])
        return out, [*kept, at] if last else kept


def scores(values: list) -> tuple[np.ndarray, np.ndarray]:
    """Scores as a row that takes over, and as one that is to be taken over: null does neither; NaN is the greatest."""
    new = np.array([-np.inf if v is None else np.inf if v != v else v for v in values], np.float64)
    return new, np.array([np.inf if v is None else x for v, x in zip(values, new, strict=True)], np.float64)


def carry(summaries: Iterator[dict]) -> Iterator[tuple[dict, dict | None]]:
    """Each stretch's summary, in order, with the survivor that comes into it."""
    now = None
    for one in summaries:
        yield one, now
        runs = one["runs"]
        if now is None:
            now = runs[0]["exit"]
            continue
        bar = scores([now["q"]])[1][0]
        now = next((r["exit"] for r in runs if r["start"] >= now["e"] or r["score"] > bar), now)


def resolve_overlaps(rows: DataFrame, keys: list[str], score: str, identity: str, start: str = "start", end: str = "end", stretch: int = STRETCH) -> DataFrame:
    """Survivors of a pass in order: a row that overlaps the current survivor replaces it if strictly better.

    The pass is a fold, and runs as a parallel scan: stretches are reduced to the runs of :class:`Pass`, one task a key walks over
    the stretches' runs to tell which survivor comes into each, and each stretch then tells its own. No task holds more than a stretch's rows, or a
    key's runs (one or a few a stretch), however long rows overlap. Equal starts go by end, then identity. Null scores neither replace nor are replaced.
    """
    ship(rows.sparkSession)
    x = rows.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(start).alias("s"), F.col(end).alias("e"), F.col(identity).alias("i"), F.col(score).cast("double").alias("q"))
    x = x.where("s is not null and e is not null").withColumn("_at", F.floor(F.col("s") / stretch))
    names = [f"k{i}" for i in range(len(keys))]
    row_type = T.StructType([x.schema[c] for c in ("s", "e", "i", "q")])
    run_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("exit", row_type)]))
    key_fields = [x.schema[c] for c in names]
    at_field = T.StructField("_at", T.LongType())
    from pyspark.sql.pandas.types import to_arrow_schema

    summary_schema = T.StructType([*key_fields, at_field, T.StructField("runs", run_type)])
    incoming_schema = T.StructType([*key_fields, at_field, T.StructField("carried", row_type), T.StructField("last", T.BooleanType())])
    out_schema = T.StructType([*key_fields, *row_type.fields])
    arrow = {k: to_arrow_schema(v) for k, v in (("summary", summary_schema), ("incoming", incoming_schema), ("out", out_schema))}

    def heads(table: pa.Table) -> dict:
        return {c: table.column(c)[0].as_py() for c in [*names, "_at"]}

    def reduce(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([heads(table) | {"runs": Pass(table.select(["s", "e", "i", "q"])).runs()}], arrow["summary"])

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        slices = (table.slice(i, 1).to_pylist()[0] for i in range(table.num_rows))
        out = [{c: one[c] for c in [*names, "_at"]} | {"carried": now, "last": False} for one, now in carry(slices)]
        out[-1]["last"] = True
        return pa.Table.from_pylist(out, arrow["incoming"])

    def settle(table: pa.Table, incoming: pa.Table) -> pa.Table:
        own = Pass(table.select(["s", "e", "i", "q"]))
        told = incoming.select(["carried", "last"]).to_pylist()[0]
        before, places = own.survivors(told["carried"], told["last"])
        key = {c: table.column(c)[0].as_py() for c in names}
        return pa.Table.from_pylist([key | r for r in [*before, *map(own.row, places)]], arrow["out"])

    groups = [*names, "_at"]
    incoming = x.groupBy(*groups).applyInArrow(reduce, summary_schema).groupBy(*names).applyInArrow(walk, incoming_schema)
    kept = x.groupBy(*groups).cogroup(incoming.groupBy(*groups)).applyInArrow(settle, out_schema)
    return kept.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], F.col("s").alias(start), F.col("e").alias(end), F.col("i").alias(identity), F.col("q").alias(score))


def is_sorted(rows: DataFrame, keys: list[str], by: str, order: str) -> DataFrame:
    """Violations: rows whose ``by`` is below the one before in the input's own ``order`` column. A key is as many tasks as the order has buckets."""
    return with_previous(rows, keys, order, by, "_before").where(F.col(by) < F.col("_before")).drop("_before")
