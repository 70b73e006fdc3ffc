"""Score calibration: fitting tables from scores of known truth, and applying them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.prefix import running

#: Options of a fit.
MAX_LLR, POINTS, BANDWIDTH, LEAST_DENSITY, PLATEAU_EPS, CLIP = 200.0, 5001, 0.8, 5e-8, 1e-6, 1


def cells(llrs: DataFrame, by: list[str], bandwidth: float = BANDWIDTH, weight: str | None = None) -> DataFrame:
    """by, cell, n: scores counted by cells of a hundredth of the bandwidth, on the map side first."""
    x = llrs.where(F.col("llr").isNotNull() & ~F.isnan("llr"))
    return x.groupBy(*by, F.rint(F.col("llr") / (bandwidth / 100)).alias("cell")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))


def cell_densities(counted: DataFrame, by: list[str], low: Column, high: Column, points: int, bandwidth: float = BANDWIDTH) -> DataFrame:
    """by, i, at, density from :func:`cells`, on a grid of ``points`` from low to high (which may differ by key).

    Each cell adds its kernel to the grid points within eight bandwidths, so work follows the cells and not the rows times the grid.
    """
    total = counted.groupBy(*by).agg(F.sum("n").alias("total"))
    step = (high - low) / (points - 1)
    centre = F.col("cell") * (bandwidth / 100)
    first = F.greatest(F.ceil((centre - 8 * bandwidth - low) / step), F.lit(0))
    last = F.least(F.floor((centre + 8 * bandwidth - low) / step), F.lit(points - 1))
    spread = counted.withColumn("_c", centre).withColumn("i", F.explode(F.when(first <= last, F.sequence(first, last))))
    z = (low + F.col("i") * step - F.col("_c")) / bandwidth
    k = F.col("n") * F.exp(-z * z / 2) / (bandwidth * float(np.sqrt(2 * np.pi)))
    sums = spread.groupBy(*by, "i").agg(F.sum(k).alias("s"))
    return sums.join(F.broadcast(total), by).select(*by, "i", (low + F.col("i") * step).alias("at"), (F.col("s") / F.col("total")).alias("density"))


def densities(llrs: DataFrame, by: list[str], low: float, high: float, points: int, bandwidth: float = BANDWIDTH) -> DataFrame:
    """by, i, at, density: gaussian kernel density of ``llr`` on a grid."""
    return cell_densities(cells(llrs, by, bandwidth), by, F.lit(low), F.lit(high), points, bandwidth)


def exact_densities(llrs: DataFrame, by: list[str], low: float, high: float, points: int, bandwidth: float = BANDWIDTH) -> DataFrame:
    """by, i, density without cells: every score adds its kernel to every grid point, summed per batch in numpy."""
    grid = np.linspace(low, high, points)
    kinds = ", ".join(f"{c} {llrs.schema[c].dataType.simpleString()}" for c in by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, part in b.groupby(by):
                x = part["llr"].to_numpy()
                s = np.zeros(points)
                for i in range(0, len(x), 2000):
                    z = (grid[None, :] - x[i : i + 2000, None]) / bandwidth
                    s += np.exp(-z * z / 2).sum(0)
                yield pd.DataFrame({c: k for c, k in zip(by, key, strict=True)} | {"i": np.arange(points), "s": s / (bandwidth * np.sqrt(2 * np.pi)), "n": len(x)})

    parts = llrs.where("llr is not null and not isnan(llr)").select(*by, "llr").mapInPandas(run, f"{kinds}, i int, s double, n long")
    return parts.groupBy(*by, "i").agg((F.sum("s") / F.sum("n")).alias("density"))


def monotone(y: np.ndarray, rising: bool = True) -> np.ndarray:
    """Mean of the running maximum and the running minimum from the other end: a monotone curve."""
    if not rising:
        return monotone(y[::-1])[::-1]
    return (np.maximum.accumulate(y) + np.minimum.accumulate(y[::-1])[::-1]) / 2


def unimodal(y: np.ndarray) -> np.ndarray:
    """A density made monotone on either side of its peak."""
    top = int(np.argmax(y))
    return np.concatenate([monotone(y[: top + 1]), monotone(y[top:], False)[1:]])


def falling(p: np.ndarray, middle: int) -> np.ndarray:
    """A curve that never rises: before ``middle`` the maximum of what is to come up to it, from there on the minimum so far."""
    return np.r_[np.maximum.accumulate(p[:middle][::-1])[::-1], np.minimum.accumulate(p[middle:])]


def log_ratio(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.log((1 - p) / p)


def modified_share(canonical: np.ndarray, modified: np.ndarray) -> np.ndarray:
    """P(modified) by the two densities; NaN where both are 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return modified / (canonical + modified)


def moving_range(canonical: np.ndarray, modified: np.ndarray, grid: np.ndarray, eps: float, buffer: float) -> tuple[float, float]:
    """Scores between which the log-ratio still moves, to whole numbers and ``buffer`` beyond; (0, 0) if it never does."""
    with np.errstate(invalid="ignore"):
        moves = np.flatnonzero(np.diff(log_ratio(falling(modified_share(canonical, modified), int(np.rint(len(grid) / 2))))) > eps)
    return (0.0, 0.0) if not len(moves) else (float(np.rint(grid[moves[0]])) - buffer, float(np.rint(grid[moves[-1]])) + buffer)


def dense_range(canonical: np.ndarray, modified: np.ndarray, grid: np.ndarray, least: float) -> tuple[float, float]:
    """Scores between which neither density, going out from its peak, has fallen below the least one; whole numbers."""
    low, high = 0, len(grid) - 1
    for y in (canonical, modified):
        top, thin = int(np.argmax(y)), np.flatnonzero(y < least)
        low = max([low, *thin[thin < top].tolist()])
        high = min([high, *(thin[thin >= top] - 1).tolist()])
    return float(np.rint(grid[low])), float(np.rint(grid[high]))


def fitted_range(canonical: np.ndarray, modified: np.ndarray, grid: np.ndarray, eps: float = PLATEAU_EPS, least: float = LEAST_DENSITY, buffer: float = CLIP) -> tuple[float, float]:
    """The range of scores for a table: where both densities are enough and the log-ratio moves. An error if there is none."""
    moving, dense = moving_range(canonical, modified, grid, eps, buffer), dense_range(canonical, modified, grid, least)
    low, high = max(moving[0], dense[0]), min(moving[1], dense[1])
    if high <= low:
        raise ValueError("the densities of both classes do not overlap; a smaller least density may help")
    return low, high


def fitted_table(canonical: np.ndarray, modified: np.ndarray, mirrored: bool = False) -> np.ndarray:
    """Calibrated log-ratios on the densities' grid: those of a P(modified) that falls on either side of one half."""
    p = modified_share(canonical, modified)
    middle = int(np.rint(len(p) / 2)) if mirrored else int(np.argmin(np.abs(p - 0.5)))
    return log_ratio(falling(p, middle))


def fit(stats: DataFrame, key: str = "mod_base", max_llr: float = MAX_LLR, points: int = POINTS, bandwidth: float = BANDWIDTH, eps: float = PLATEAU_EPS, least: float = LEAST_DENSITY, buffer: float = CLIP, mirrored: bool = False, weight: str | None = None) -> DataFrame:
    """key, lo, hi, table from rows (key, is_mod, llr).

    Two passes over the cells of scores: densities on the whole range tell where they bear a table, and densities made again on that
    range, with as many points, give it. ``mirrored``: only rows with is_mod false count, and the other class is their
    mirror image. A group holds one key's grid of two densities. A job fails with ValueError where a key's densities do not overlap.
    """
    counted = cells(stats.where(~F.col("is_mod")) if mirrored else stats, [key, "is_mod"], bandwidth, weight)
    kind = stats.schema[key].dataType.simpleString()

    def both(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for flag in (False,) if mirrored else (False, True):
            x, y = pdf[pdf["is_mod"] == flag], np.zeros(points)
            y[x["i"].to_numpy()] = x["density"].to_numpy()
            out.append(unimodal(y))
        return (out[0], out[0][::-1]) if mirrored else (out[0], out[1])

    def narrow(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = fitted_range(*both(pdf), np.linspace(-max_llr, max_llr, points), eps, least, buffer)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "lo": [low], "hi": [high]})

    def tabulate(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [pdf[key].iloc[0]], "lo": [pdf["lo"].iloc[0]], "hi": [pdf["hi"].iloc[0]], "table": [fitted_table(*both(pdf), mirrored)]})

    whole = cell_densities(counted, [key, "is_mod"], F.lit(-max_llr), F.lit(max_llr), points, bandwidth)
    ranges = whole.groupBy(key).applyInPandas(narrow, f"{key} {kind}, lo double, hi double")
    again = cell_densities(counted.join(F.broadcast(ranges), key), [key, "is_mod", "lo", "hi"], F.col("lo"), F.col("hi"), points, bandwidth)
    return again.groupBy(key).applyInPandas(tabulate, f"{key} {kind}, lo double, hi double, table array<double>")


def look_up(score: Column, lo: Column, hi: Column, table: Column) -> Column:
    """The table's entry at the first grid point not below the score; the last entry beyond the range; the score itself without a table."""
    n = F.size(table)
    step = (hi - lo) / (n - 1)
    guess = F.ceil((score - lo) / step)
    # One step down or up mends what rounding of the division may do.
    grid = lambda i: lo + i * step
    at = F.when(grid(guess - 1) >= score, guess - 1).when(grid(guess) < score, guess + 1).otherwise(guess)
    return F.when(table.isNull(), score).otherwise(F.get(table, F.greatest(F.least(at, n - 1), F.lit(0)).cast("int")))


def calibrate(llrs: DataFrame, tables: DataFrame, key: str = "mod_base") -> DataFrame:
    """Adds calibrated; keys without a table keep their score. A table a key makes the right side small."""
    x = llrs.join(F.broadcast(tables), key, "left")
    return x.withColumn("calibrated", look_up(F.col("llr"), F.col("lo"), F.col("hi"), F.col("table"))).drop("lo", "hi", "table")


def variant_key(ref: Column, alt: Column, max_indel: int = 50) -> Column:
    """Key of a variant's table: the pair of a single-base change, N>N for other changes, or kind and clamped length of an indel."""
    n = F.least(F.abs(F.length(ref) - F.length(alt)), F.lit(max_indel)).cast("string")
    snp = F.when((F.length(ref) == 1) & (F.length(alt) == 1), F.concat(ref, F.lit(">"), alt)).otherwise("N>N")
    return F.when(F.length(ref) == F.length(alt), snp).when(F.length(ref) > F.length(alt), F.concat(F.lit("del"), n)).otherwise(F.concat(F.lit("ins"), n))


#: Key of changes of equal length that have no table of their own.
GENERIC = "N>N"


def lookup_key(ref: Column, alt: Column, max_indel: int) -> Column:
    """Key of the table that a read's alleles look up: of alleles of equal length the one base that differs, and else the generic key; long indels take the longest one's."""
    pairs = F.zip_with(F.split(ref, ""), F.split(alt, ""), lambda r, a: F.concat(r, F.lit(">"), a))
    differ = F.filter(pairs, lambda p: F.substring(p, 1, 1) != F.substring(p, 3, 1))
    one = F.when(F.size(differ) == 1, F.get(differ, F.lit(0))).otherwise(GENERIC)
    return F.when(F.length(ref) == F.length(alt), one).otherwise(variant_key(ref, alt, max_indel))


def variant_stats(stats: DataFrame, max_indel: int | None = None) -> DataFrame:
    """key, is_mod (false), llr, n: scores of variants whose reference is right, for a mirrored fit.

    Rows with a wrong reference, no score, or an indel longer than ``max_indel`` are left out. N>N takes every twelfth of all
    single-base changes, in an order by hash in which equal rows are neighbours: as many as one of the twelve kinds has.
    """
    right = stats.where((F.lower(F.col("is_ref_correct").cast("string")) == "true") & F.col("llr").isNotNull() & ~F.isnan("llr"))
    grown = F.abs(F.length("ref_seq") - F.length("alt_seq"))
    if max_indel is not None:
        right = right.where(grown <= max_indel)
    single = (F.length("ref_seq") == 1) & (F.length("alt_seq") == 1)
    indel = F.when(F.length("ref_seq") > F.length("alt_seq"), F.concat(F.lit("del"), grown.cast("string"))).otherwise(F.concat(F.lit("ins"), grown.cast("string")))
    keyed = right.select(F.when(single, F.concat("ref_seq", F.lit(">"), "alt_seq")).otherwise(indel).alias("key"), single.alias("single"), F.col("llr").cast("double").alias("llr"))
    counts = keyed.groupBy("key", "single", "llr").agg(F.count(F.lit(1)).alias("n"))
    # The running count over all rows goes bucket by bucket, so that no task sorts them all.
    hashed = counts.where("single").withColumn("_h", F.xxhash64("key", "llr")).withColumn("_all", F.lit(0))
    before = running(hashed, ["_all"], ["_h", "key", "llr"], F.shiftright("_h", 56), {"before": F.col("n")})
    twelfth = F.floor((F.col("before") + F.col("n")) / 12) - F.floor(F.col("before") / 12)
    generic = before.select(F.lit(GENERIC).alias("key"), "llr", twelfth.cast("long").alias("n")).where("n > 0")
    return counts.select("key", "llr", "n").unionByName(generic).withColumn("is_mod", F.lit(False))


def check_variant_keys(keys: list[str]) -> int:
    """The longest indel; an error unless there are single-base changes and both kinds of indels in all lengths from 1 to that."""
    lengths = {kind: {int(k[3:]) for k in keys if k.startswith(kind)} for kind in ("del", "ins")}
    if not any(">" in k and k != GENERIC for k in keys) or not all(lengths.values()):
        raise ValueError("the statistics lack single-base changes, insertions or deletions")
    if lengths["del"] != lengths["ins"] or lengths["ins"] != set(range(1, max(lengths["ins"]) + 1)):
        raise ValueError("insertions and deletions need the same lengths, every one from 1 on")
    return max(lengths["ins"])


def fit_variants(stats: DataFrame, max_indel: int | None = None, **options) -> DataFrame:
    """key, lo, hi, table by kind of variant, from rows is_ref_correct, llr, ref_seq, alt_seq."""
    rows = variant_stats(stats, max_indel)
    check_variant_keys([r["key"] for r in rows.select("key").distinct().collect()])
    return fit(rows, "key", mirrored=True, weight="n", **options)


def calibrate_variants(llrs: DataFrame, tables: DataFrame) -> DataFrame:
    """Adds calibrated to rows llr, ref_seq, alt_seq. Single-base changes without a table of their own, and other changes of equal length, take the generic one."""
    keys = [r["key"] for r in tables.select("key").distinct().collect()]
    key = lookup_key(F.col("ref_seq"), F.col("alt_seq"), check_variant_keys(keys))
    known = F.array(*[F.lit(k) for k in keys])
    x = llrs.withColumn("_key", key).withColumn("_key", F.when(F.array_contains(known, F.col("_key")), F.col("_key")).otherwise(GENERIC))
    y = x.join(F.broadcast(tables.select(F.col("key").alias("_key"), "lo", "hi", "table")), "_key", "left")
    return y.select(*llrs.columns, look_up(F.col("llr"), F.col("lo"), F.col("hi"), F.col("table")).alias("calibrated"))


#: Version of stored tables.
FORMAT = 1


def store(tables: DataFrame, path: str, key: str) -> None:
    """Write tables to a folder; its manifest comes last, so that a half-written folder has none."""
    spark = tables.sparkSession
    tables.write.parquet(f"{path}/tables")
    written = spark.read.parquet(f"{path}/tables")
    sizes = written.agg(F.count(F.lit(1)).alias("keys"), F.min(F.size("table")).alias("least"), F.max(F.size("table")).alias("most"))
    sizes.select(F.lit(FORMAT).alias("format"), F.lit(key).alias("key"), "keys", "least", "most").coalesce(1).write.json(f"{path}/manifest")


def load(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Tables that :func:`store` has written; an error where the manifest is not there, or of another format or key, or not of these tables."""
    try:
        told = spark.read.schema("format int, key string, keys long, least int, most int").json(f"{path}/manifest").first()
    except AnalysisException as e:
        raise ValueError(f"{path} holds no finished calibration tables") from e
    if told is None or told["format"] != FORMAT or told["key"] != key:
        raise ValueError(f"{path} holds tables of another format or key: {told}")
    tables = spark.read.parquet(f"{path}/tables")
    if tables.count() != told["keys"] or not {key, "lo", "hi", "table"} <= set(tables.columns):
        raise ValueError(f"{path} does not hold what its manifest says")
    return tables
