"""Modified-base calls: from per-read log-probabilities to calls per site.

Input is long: site columns, read_id, mod_base, score (natural log). The alphabet of
modified bases is known to the driver (:func:`alphabet`), so one aggregate by (site,
read) turns reads into rows and a second by site counts them. Both have partial forms,
so a deep site costs each task one row. A repeated (site, read, mod) keeps its
largest score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.expr import NAN, expit, log1m
from strandlake.operators.prefix import exact_quantiles, running, score_buckets
from strandlake.session import materialize

SITE = ["chrm", "pos", "strand"]

#: Default probability threshold, and options of the mixture estimate.
THRESHOLD = 0.8
EM_ITERATIONS, EM_TOLERANCE, EM_LEAST = 15, 0.001, 0.001
#: Distinct vectors of a site from which on its estimate is a series of joins and sums, and shares its rows are dealt to.
EM_DEEP, EM_SHARES = 20_000, 64


def alphabet(calls: DataFrame) -> list[str]:
    """Modified bases in use; a handful whatever the data."""
    return sorted(r[0] for r in calls.select("mod_base").distinct().collect())


def read_level(calls: DataFrame, mods: list[str], site: list[str] = SITE) -> DataFrame:
    """A row a site and read: a column score_x for each mod (null where missing) and can_lp."""
    aggs = [F.max(F.when(F.col("mod_base") == m, F.col("score"))).alias(f"score_{m}") for m in mods]
    total = sum((F.coalesce(F.exp(f"score_{m}"), F.lit(0.0)) for m in mods[1:]), F.coalesce(F.exp(f"score_{mods[0]}"), F.lit(0.0)))
    return calls.groupBy(*site, "read_id").agg(*aggs).withColumn("can_lp", log1m(total))


def best_mod(mods: list[str]) -> Column:
    """Struct (lp, mod) of the likeliest mod; the first in order of the alphabet on a tie."""
    out = F.struct(F.col(f"score_{mods[0]}").alias("lp"), F.lit(mods[0]).alias("mod"))
    for m in mods[1:]:
        here = F.col(f"score_{m}")
        out = F.when(here.isNotNull() & (out["lp"].isNull() | (here > out["lp"])), F.struct(here.alias("lp"), F.lit(m).alias("mod"))).otherwise(out)
    return out


def winners(reads: DataFrame, mods: list[str]) -> DataFrame:
    """Adds winner ('can' or a mod) and win_lp; an undefined canonical probability loses."""
    top = best_mod(mods)
    canonical = (~F.isnan("can_lp")) & (F.col("can_lp") > top["lp"])
    return reads.withColumn("winner", F.when(canonical, F.lit("can")).otherwise(top["mod"])).withColumn("win_lp", F.when(canonical, F.col("can_lp")).otherwise(top["lp"]))


def _spread(sites: DataFrame, mods: list[str], site: list[str], values: dict[str, str]) -> DataFrame:
    """Long form again: a row a site and mod."""
    rows = F.array(*[F.struct(F.lit(m).alias("mod_base"), *[F.col(f"{v}_{m}").alias(name) for name, v in values.items()]) for m in mods])
    kept = [c for c in ("reads", "valid_reads") if c in sites.columns]
    return sites.select(*site, *kept, F.explode(rows).alias("x")).select(*site, *kept, "x.*")


def binary_threshold(calls: DataFrame, threshold: float = THRESHOLD, mods: list[str] | None = None, site: list[str] = SITE) -> DataFrame:
    """site, reads, valid_reads, mod_base, n_mod, prop: reads whose winner is likelier than the threshold count."""
    mods = mods or alphabet(calls)
    reads = winners(read_level(calls, mods, site), mods)
    sure = F.exp("win_lp") > threshold
    aggs = [F.sum((sure & (F.col("winner") == m)).cast("long")).alias(f"n_{m}") for m in mods]
    sites = reads.groupBy(*site).agg(F.count(F.lit(1)).alias("reads"), F.sum(sure.cast("long")).alias("valid_reads"), *aggs)
    out = _spread(sites, mods, site, {"n_mod": "n"})
    return out.withColumn("prop", F.when(F.col("valid_reads") > 0, F.col("n_mod") / F.col("valid_reads")).otherwise(0.0))


def expit_scaled(calls: DataFrame, mods: list[str] | None = None, site: list[str] = SITE) -> DataFrame:
    """site, reads, mod_base, prop: winners weighted by a logistic of their probability."""
    mods = mods or alphabet(calls)
    reads = winners(read_level(calls, mods, site), mods).withColumn("w", expit(F.exp("win_lp")))
    aggs = [F.sum(F.when(F.col("winner") == m, F.col("w")).otherwise(0.0)).alias(f"w_{m}") for m in mods]
    sites = reads.groupBy(*site).agg(F.count(F.lit(1)).alias("reads"), F.sum("w").alias("w_all"), *aggs)
    sites = sites.select(*site, "reads", *[(F.col(f"w_{m}") / F.col("w_all")).alias(f"prop_{m}") for m in mods])
    return _spread(sites, mods, site, {"prop": "prop"})


def em(calls: DataFrame, mods: list[str] | None = None, iterations: int = EM_ITERATIONS, tolerance: float = EM_TOLERANCE, least: float = EM_LEAST, deep: int = EM_DEEP, site: list[str] = SITE) -> DataFrame:
    """site, reads, dropped_reads, mod_base, prop by expectation maximisation.

    Reads that lack a mod are dropped and counted. Equal probability vectors of a site are counted first, by an
    aggregate with a partial form. Sites of at most ``deep`` distinct vectors are estimated each from one array; deeper
    ones by a join and a partial sum for each iteration, so no task holds a deep site's reads.
    """
    mods = mods or alphabet(calls)
    p = [f"p_{m}" for m in mods]
    whole = ~F.isnan("can_lp")
    for m in mods:
        whole = whole & F.col(f"score_{m}").isNotNull()
    reads = read_level(calls, mods, site).withColumn("whole", whole)
    vectors = reads.select(*site, "whole", *[F.when(F.col("whole"), F.exp(f"score_{m}")).alias(c) for m, c in zip(mods, p, strict=True)])
    counted = materialize(vectors.groupBy(*site, "whole", *p).agg(F.count(F.lit(1)).alias("n")), "em-vectors")
    sizes = counted.groupBy(*site).agg(F.count(F.lit(1)).alias("size"))
    hot = materialize(sizes.where(F.col("size") > deep).select(*[F.col(c).alias(f"hot_{c}") for c in site]), "em-deep")
    same = [F.col(c).eqNullSafe(F.col(f"hot_{c}")) for c in site]
    some_hot = not hot.isEmpty()
    out = _em_arrays(counted.join(hot, same, "left_anti") if some_hot else counted, mods, site, iterations, tolerance, least)
    if some_hot:
        out = out.unionByName(_em_joins(counted.join(hot, same, "left_semi"), mods, site, iterations, tolerance, least))
    rows = F.arrays_zip(F.array(*[F.lit(m) for m in mods]).alias("mod_base"), F.col("props").alias("prop"))
    return out.select(*site, "reads", "dropped_reads", F.explode(rows).alias("x")).select(*site, "reads", "dropped_reads", F.col("x")["mod_base"].alias("mod_base"), F.col("x")["prop"].alias("prop"))


def _em_totals() -> list[Column]:
    return [F.sum("n").alias("reads"), F.sum(F.when(~F.col("whole"), F.col("n")).otherwise(0)).alias("dropped_reads")]


def _em_arrays(counted: DataFrame, mods: list[str], site: list[str], iterations: int, tolerance: float, least: float) -> DataFrame:
    """site, reads, dropped_reads, props of sites whose vectors fit an array."""
    head = [*site, "reads", "dropped_reads"]
    packed = counted.groupBy(*site).agg(*_em_totals(), F.array_sort(F.collect_list(F.when(F.col("whole"), F.struct(*[f"p_{m}" for m in mods], "n")))).alias("v")).where("reads > dropped_reads")
    kinds = ", ".join(f"{c} {packed.schema[c].dataType.simpleString()}" for c in head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            ends, fields = lists.offsets.to_numpy(), lists.values
            a = np.stack([fields.field(f"p_{m}").to_numpy() for m in mods], 1)
            n = fields.field("n").to_numpy().astype(np.float64)
            probs = np.concatenate([np.maximum(1 - a.sum(1, keepdims=True), 0), a], 1)
            props = [em_weighted(probs[i:j], n[i:j], iterations, tolerance, least)[1:].tolist() for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in head), pa.array(props, pa.list_(pa.float64()))], names=[*head, "props"])

    return packed.mapInArrow(run, f"{kinds}, props array<double>")


def _em_joins(counted: DataFrame, mods: list[str], site: list[str], iterations: int, tolerance: float, least: float) -> DataFrame:
    """As :func:`_em_arrays` for sites of any depth: a site's rows are dealt to shares, and every step is a join and two partial sums."""
    k = len(mods) + 1
    p = [F.col(f"p_{m}") for m in mods]
    probs = F.array(F.greatest(1 - sum(p[1:], p[0]), F.lit(0.0)), *p)
    share = F.pmod(F.xxhash64(*p), F.lit(EM_SHARES)).cast("int")
    # Sites are joined by a struct of their columns as text with nulls kept apart, so null sites meet.
    rows = materialize(counted.where("whole").select(F.to_json(F.struct(*site), {"ignoreNullFields": "false"}).alias("at"), share.alias("share"), probs.alias("p"), "n"), "em-rows")

    def settled(values: list[Column]) -> Column:
        clipped = F.array(*[F.least(F.greatest(v, F.lit(least)), F.lit(1.0)) for v in values])
        return F.transform(clipped, lambda x: x / F.aggregate(clipped, F.lit(0.0), lambda a, b: a + b))

    top = F.array_position("p", F.array_max("p"))
    counts = rows.groupBy("at").agg(F.sum("n").alias("total"), *[F.sum(F.when(top == j + 1, F.col("n")).otherwise(0)).alias(f"w{j}") for j in range(k)])
    mix = materialize(counts.select("at", "total", settled([F.col(f"w{j}") / F.col("total") for j in range(k)]).alias("mix"), F.lit(False).alias("done")), "em-mix")
    for _ in range(iterations):
        dealt = mix.where("not done").select("at", "mix", F.explode(F.sequence(F.lit(0), F.lit(EM_SHARES - 1))).alias("share"))
        joint = F.zip_with("p", "mix", lambda x, y: x * y)
        weighed = rows.join(dealt, ["at", "share"]).select("at", "n", joint.alias("j")).select("at", "n", "j", F.aggregate("j", F.lit(0.0), lambda a, b: a + b).alias("all"))
        sums = weighed.groupBy("at").agg(*[F.sum(F.col("n") * F.get("j", F.lit(j)) / F.col("all")).alias(f"w{j}") for j in range(k)])
        moved = mix.join(sums, "at", "left").withColumn("new", F.when(F.col("done"), F.col("mix")).otherwise(settled([F.col(f"w{j}") / F.col("total") for j in range(k)])))
        far = F.array_max(F.zip_with("new", "mix", lambda x, y: F.abs(x - y)))
        mix = materialize(moved.select("at", "total", F.col("new").alias("mix"), (F.col("done") | (far < tolerance)).alias("done")), "em-mix")
        if mix.where("not done").isEmpty():
            break
    low, high = least * 1.000001, 1 - 1.000001 * (k - 1) * least
    props = F.transform(F.slice("mix", 2, k - 1), lambda x: F.when(x <= low, 0.0).when(x >= high, 1.0).otherwise(x))
    totals = counted.groupBy(*site).agg(*_em_totals()).withColumn("at", F.to_json(F.struct(*site), {"ignoreNullFields": "false"}))
    return totals.join(mix, "at").select(*site, "reads", "dropped_reads", props.alias("props"))


def em_weighted(probs: np.ndarray, n: np.ndarray, iterations: int, tolerance: float, least: float) -> np.ndarray:
    """Mixture proportions of classes (columns, canonical first), from distinct rows of reads and their counts.

    Starts at the shares of each read's likeliest class; proportions stay within the least one, and those
    that end there are 0 (or 1).
    """
    k = probs.shape[1]
    total = n.sum()
    mix = np.bincount(probs.argmax(1), n, k) / total
    mix = np.clip(mix, least, 1.0)
    mix /= mix.sum()
    for _ in range(iterations):
        joint = probs * mix
        new = n @ (joint / joint.sum(1, keepdims=True)) / total
        new = np.clip(new, least, 1.0)
        new /= new.sum()
        done = np.abs(new - mix).max() < tolerance
        mix = new
        if done:
            break
    floor, top = least * 1.000001, 1 - 1.000001 * (k - 1) * least
    return np.where(mix <= floor, 0.0, np.where(mix >= top, 1.0, mix))


METHODS = {"binary_threshold": binary_threshold, "expit": expit_scaled, "em": em}


def aggregate(calls: DataFrame, method: str = "binary_threshold", reads: DataFrame | None = None, sites: DataFrame | None = None, **options) -> DataFrame:
    """Site calls by a named method, over listed reads and sites only where given."""
    if reads is not None:
        calls = calls.join(reads.select("read_id").distinct(), "read_id", "left_semi")
    if sites is not None:
        calls = at_sites(calls, sites)
    return METHODS[method](calls, **options)


def at_sites(calls: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows at given sites; sites without a strand (null) stand for both."""
    both = sites.where("strand is null").select("chrm", "pos")
    one = sites.where("strand is not null").select(*SITE)
    both = both.crossJoin(F.broadcast(sites.sparkSession.createDataFrame([(1,), (-1,)], "strand int"))) if "strand" in sites.columns else both
    return calls.join(one.unionByName(both).distinct(), SITE, "left_semi")


def log_prob_lists(calls: DataFrame, mods: list[str] | None = None, site: list[str] = SITE) -> DataFrame:
    """site, mod_base, log_probs: per-read scores of each site as sorted text, six decimals."""
    best = calls.groupBy(*site, "read_id", "mod_base").agg(F.max("score").alias("score"))
    texts = F.transform(F.array_sort(F.collect_list("score")), lambda x: F.format_string("%.6f", x))
    return best.groupBy(*site, "mod_base").agg(F.array_join(texts, ",").alias("log_probs"))


def site_llrs(calls: DataFrame, mods: list[str] | None = None, site: list[str] = SITE) -> DataFrame:
    """site, read_id, mod_base, llr: canonical less modified log-probability of each read."""
    mods = mods or alphabet(calls)
    reads = read_level(calls, mods, site)
    rows = F.array(*[F.struct(F.lit(m).alias("mod_base"), (F.col("can_lp") - F.col(f"score_{m}")).alias("llr")) for m in mods])
    return reads.select(*site, "read_id", F.explode(rows).alias("x")).select(*site, "read_id", "x.*").where("llr is not null")


def llr_summary(llrs: DataFrame) -> DataFrame:
    return llrs.groupBy("mod_base").agg(F.count(F.lit(1)).alias("n"), F.avg("llr").alias("mean_llr"), F.min("llr").alias("min_llr"), F.max("llr").alias("max_llr"))


def global_threshold(llrs: DataFrame, mod: str, extreme: float = 8.0, fraction: float | None = None) -> DataFrame:
    """mod_base, frac_mod, threshold: the score below which the modified fraction lies.

    Without a given fraction it is estimated from the share of scores beyond the extreme percentile
    on each side: those as low as modified reads' mirror those as high as canonical ones'.
    """
    # What follows goes over the scores several times: they are counted once, and their counts are read.
    x = materialize(llrs.where(F.col("mod_base") == mod).groupBy("mod_base", "llr").agg(F.count(F.lit(1)).alias("n")), "llr-counts")
    if fraction is None:
        # Two exact order statistics of the whole table, by running counts; a value each comes to the driver.
        bounds = [r["value"] for f in (extreme / 100, 1 - extreme / 100) for r in exact_quantiles(x, ["mod_base"], "llr", f, "n").collect()]
        cut = min(map(abs, bounds), default=0.0)
        low, high = F.sum(F.when(F.col("llr") <= -cut, F.col("n")).otherwise(0)), F.sum(F.when(F.col("llr") >= cut, F.col("n")).otherwise(0))
        row = x.agg((low / F.greatest(low + high, F.lit(1))).alias("f")).first()
        fraction = float(row["f"] or 0.0)
    return exact_quantiles(x, ["mod_base"], "llr", fraction, "n").select("mod_base", F.lit(fraction).alias("frac_mod"), F.col("value").alias("threshold"))


def array_percentile(values: Column, p: Column) -> Column:
    """Linear interpolation between order statistics, with a percentile (0 to 1) of the row's own."""
    s = F.array_sort(values)
    at = p * (F.size(s) - 1)
    low = F.floor(at).cast("int")
    high = F.least(low + 1, F.size(s) - 1)
    return F.get(s, low) + (at - low) * (F.get(s, high) - F.get(s, low))


def per_site_thresholds(llrs: DataFrame, truth: DataFrame, mod: str, least_truth: int = 15, least_reads: int = 30, site: list[str] = SITE) -> DataFrame:
    """site, reads, truth_cov, pct, threshold, status ('ok', 'low_truth' or 'low_reads').

    truth: site, cov, mod_cov. A site that is never modified gets -100, one that always is +100, else
    the percentile of its reads' ratios at its modified share.
    """
    x = llrs.where(F.col("mod_base") == mod)
    values = x.groupBy(*site, "llr").agg(F.count(F.lit(1)).alias("_n"))
    reads = x.groupBy(*site).agg(F.count(F.lit(1)).alias("reads"))
    share = F.col("mod_cov") / F.col("cov")
    facts = truth.join(reads, site, "left").withColumn("reads", F.coalesce("reads", F.lit(0))).withColumn("_at", share * (F.col("reads") - 1))
    # Values at the two ranks round the wanted one, from running counts of distinct values.
    ranked = running(values, site, ["llr"], score_buckets(x, "llr"), {"_before": F.col("_n")}).join(facts.select(*site, "_at", "reads"), site)
    low = F.floor("_at")
    high = F.least(low + 1, F.col("reads") - 1)
    here = lambda k: F.max(F.when((F.col("_before") <= k) & (k < F.col("_before") + F.col("_n")), F.col("llr")))
    found = ranked.groupBy(*site).agg(here(low).alias("_low"), here(high).alias("_high"))
    y = facts.join(found, site, "left")
    between = F.col("_low") + (F.col("_at") - F.floor("_at")) * (F.col("_high") - F.col("_low"))
    threshold = F.when(share <= 0, -100.0).when(share >= 1, 100.0).otherwise(between)
    status = F.when(F.col("cov") < least_truth, "low_truth").when(F.col("reads") < least_reads, "low_reads").otherwise("ok")
    return y.select(*site, "reads", F.col("cov").alias("truth_cov"), (100 * share).alias("pct"), F.when(status == "ok", threshold).alias("threshold"), status.alias("status"))


def contig_offsets(contigs: DataFrame) -> DataFrame:
    """chrm, chrm_len, offset: twice the lengths before, in natural order of names."""
    from strandlake.functions.expr import natural_key

    # A genome has few contigs; their table is the size of a header.
    w = Window.orderBy(natural_key("chrm"), "chrm").rowsBetween(Window.unboundedPreceding, -1)
    return contigs.select("chrm", "chrm_len", F.coalesce(F.sum(2 * F.col("chrm_len")).over(w), F.lit(0)).alias("offset"))


def encode_positions(calls: DataFrame, offsets: DataFrame) -> DataFrame:
    """Adds pos_id; positions beyond a contig's end are an error."""
    at = F.col("offset") + 2 * F.col("pos") + F.when(F.col("strand") == -1, 1).otherwise(0)
    checked = F.when((F.col("pos") < 0) | (F.col("pos") >= F.col("chrm_len")), F.raise_error(F.lit("position beyond contig")).cast("long")).otherwise(at)
    return calls.join(F.broadcast(offsets), "chrm").withColumn("pos_id", checked).drop("offset", "chrm_len")


def decode_positions(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """chrm, pos, strand from pos_id, by the greatest offset not beyond it."""
    table = F.array_sort(F.collect_list(F.struct("offset", "chrm")))
    all_ = offsets.agg(table.alias("t"))
    x = rows.crossJoin(F.broadcast(all_))  # one row: the header
    found = F.element_at(F.filter("t", lambda o: o["offset"] <= F.col("pos_id")), -1)
    rest = F.col("pos_id") - found["offset"]
    return x.select(*rows.columns, found["chrm"].alias("chrm"), F.floor(rest / 2).alias("pos"), F.when(rest % 2 == 1, -1).otherwise(1).alias("strand"))


def position_range(calls: DataFrame, chrm: str, start: int, end: int) -> DataFrame:
    """Both strands of [start, end) of a contig; the predicate reaches the scan."""
    return calls.where((F.col("chrm") == chrm) & (F.col("pos") >= start) & (F.col("pos") < end))


def edge_buffer(calls: DataFrame, reads: DataFrame, buffer: int, variants: bool = False) -> DataFrame:
    """Calls at least ``buffer`` from their read's ends; for mods strictly beyond it, for variants inclusive."""
    x = calls.join(reads.select("read_id", "r_st", "r_en"), "read_id")
    left, right = F.col("pos") - F.col("r_st"), F.col("r_en") - F.col("pos")
    keep = (left >= buffer) & (right >= buffer) if variants else (left > buffer) & (right > buffer)
    return x.where(keep).drop("r_st", "r_en")
