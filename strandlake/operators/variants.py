"""Sequence-variant calls: genotype probabilities per locus, alleles, records."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.expr import log1m, log_factorial, logsumexp, trim_alleles
from strandlake.operators import tiles
from strandlake.operators.prefix import running, score_buckets
from strandlake.session import deal, materialize

LOCUS = ["locus"]


def read_scores(calls: DataFrame, locus: list[str] = LOCUS) -> DataFrame:
    """A row a locus and read: alts (in order) and scores (reference first). A repeated (locus, read, alternative) keeps its largest score. The reference gets what the alternatives leave of 1. Rows without a locus are left out."""
    best = calls.dropna(subset=locus).groupBy(*locus, "read_id", "alt_seq").agg(F.max("score").alias("score"))
    reads = best.groupBy(*locus, "read_id").agg(F.array_sort(F.collect_list(F.struct("alt_seq", "score"))).alias("a"), log1m(F.sum(F.exp("score"))).alias("ref"))
    return reads.select(*locus, "read_id", F.transform("a", lambda x: x["alt_seq"]).alias("alts"), F.concat(F.array("ref"), F.transform("a", lambda x: x["score"])).alias("scores"))


def complete_reads(calls: DataFrame, locus: list[str] = LOCUS) -> DataFrame:
    """:func:`read_scores` at loci at which every read scores every alternative; a locus's reads are together, and tasks take a bounded number of pairs of alleles beside deep loci."""
    held = materialize(read_scores(calls, locus), "read-scores")
    pairs = held.agg(F.sum(F.size("scores") * (F.size("scores") - 1) / 2)).first()[0]
    reads = deal(held, *locus, rows=int(pairs or 0))
    # Every read scores every alternative where all reads' lists are the same one.
    same = reads.groupBy(*locus).agg(F.min("alts").alias("_a"), F.max("alts").alias("_b")).where("_a = _b").select(*locus)
    return reads.join(same, locus, "left_semi")


def _sums(reads: DataFrame, locus: list[str], bonus: Column | None = None) -> DataFrame:
    """locus, rank, lp, reads, alts: each allele's summed scores, with ``bonus`` a read."""
    each = reads.select(*locus, "alts", F.lit(0.0) if bonus is None else bonus.alias("_bonus"), F.posexplode("scores").alias("rank", "s")).toDF(*locus, "alts", "_bonus", "rank", "s")
    return each.groupBy(*locus, "rank").agg((F.sum("s") + F.count(F.lit(1)) * F.max("_bonus")).alias("lp"), F.count(F.lit(1)).alias("reads"), F.first("alts").alias("alts"))


def haploid(calls: DataFrame, locus: list[str] = LOCUS) -> DataFrame:
    """locus, reads, alleles (reference first, then alternatives in order), log_probs, gt."""
    reads = read_scores(calls, locus)
    alleles = F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), "alts").alias("alt"), F.col("scores").alias("s"))
    each = reads.select(*locus, F.posexplode(alleles).alias("at", "x")).select(*locus, (F.col("at") > 0).alias("changed"), "x.alt", "x.s")
    sums = each.groupBy(*locus, "changed", "alt").agg(F.sum("s").alias("lp"), F.count(F.lit(1)).alias("n"))
    # Every read scores every alternative where each allele is scored as often as the reference, which each read has once.
    whole = sums.groupBy(*locus).agg(F.array_sort(F.collect_list(F.struct("changed", "alt", "lp"))).alias("a"), F.max("n").alias("reads"), F.min("n").alias("_least")).where("reads = _least")
    names = F.transform("a", lambda x: F.when(x["changed"], x["alt"]).otherwise("ref"))
    return _normalised(whole.select(*locus, "reads", names.alias("alleles"), F.transform("a", lambda x: x["lp"]).alias("raw")), locus)


def _normalised(sites: DataFrame, locus: list[str]) -> DataFrame:
    z = logsumexp("raw")
    out = sites.withColumn("log_probs", F.transform("raw", lambda x: x - z)).drop("raw")
    best = F.aggregate(F.sequence(F.lit(0), F.size("log_probs") - 1), F.lit(0), lambda b, i: F.when(F.get("log_probs", i) > F.get("log_probs", b), i).otherwise(b))
    return out.withColumn("gt", best.cast("int"))


def diploid(calls: DataFrame, het_factor: float | tuple[float, float] = 1.0, locus: list[str] = LOCUS) -> DataFrame:
    """locus, reads, alleles, genotypes (VCF order), log_probs, gt.

    ``het_factor``: one factor, or two, for single-base changes and for others; then ``calls`` need ref_seq, one a locus.
    A homozygous genotype sums its allele's scores and n ln(het_factor). A heterozygous one sums,
    in probability, over the number i of reads from its first allele: the binomial chance of i
    at one half, the first i reads' scores of the first allele and the other reads' of the second,
    reads ordered by how much less likely the first allele is.
    """
    reads = complete_reads(calls, locus)
    if isinstance(het_factor, tuple):
        # The factor goes by the locus's reference, which is as small as the loci, and by the alternatives that the reads carry.
        known = "ref_seq" in locus
        reads = reads.withColumn("_ref", F.col("ref_seq")) if known else reads.join(calls.groupBy(*locus).agg(F.max("ref_seq").alias("_ref")), locus)
        bonus = F.log(heterozygous_factor(F.col("_ref"), F.col("alts"), *het_factor))
    else:
        bonus = F.lit(float(np.log(het_factor)))
    hom = _sums(reads, locus, bonus)
    ranks = F.sequence(F.lit(0), F.size("scores") - 1)
    pairs = F.flatten(F.transform(ranks, lambda b: F.transform(F.filter(ranks, lambda a: a < b), lambda a: F.struct(a.alias("a1"), b.alias("a2"), F.get("scores", a).alias("s1"), F.get("scores", b).alias("s2")))))
    each = reads.select(*locus, "read_id", F.explode(pairs).alias("x")).select(*locus, "read_id", "x.*")
    key = [*locus, "a1", "a2"]
    run = Window.partitionBy(*key).orderBy(F.col("s2") - F.col("s1"), "read_id").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*key)
    x = each.select(*key, F.count(F.lit(1)).over(run).alias("i"), F.sum("s1").over(run).alias("p1"), F.sum("s2").over(run).alias("p2"), F.sum("s2").over(whole).alias("t2"), F.count(F.lit(1)).over(whole).alias("n"))
    coin = log_factorial("n") - log_factorial("i") - log_factorial(F.col("n") - F.col("i")) - F.col("n") * float(np.log(2.0))
    none = F.when(F.col("i") == 1, F.col("t2") - F.col("n") * float(np.log(2.0))).otherwise(float("-inf"))
    x = x.select(*key, (coin + F.col("p1") + F.col("t2") - F.col("p2")).alias("term"), none.alias("none"))
    # Largest term first, then the sum relative to it; both stay within the partitioning of the window above.
    x = x.withColumn("top", F.max(F.greatest("term", "none")).over(whole))
    share = lambda c: F.when(F.col("top") == float("-inf"), 0.0).otherwise(F.exp(F.col(c) - F.col("top")))
    het = x.groupBy(*key, "top").agg(F.sum(share("term") + share("none")).alias("z"))
    het = het.select(*key, F.when(F.col("z") > 0, F.col("top") + F.log("z")).otherwise(F.lit(float("-inf"))).alias("lp"))
    rows = hom.select(*locus, F.col("rank").alias("a1"), F.col("rank").alias("a2"), "lp", "reads", "alts").unionByName(het, allowMissingColumns=True)
    g = rows.groupBy(*locus).agg(F.array_sort(F.collect_list(F.struct("a2", "a1", "lp"))).alias("g"), F.max("reads").alias("reads"), F.first("alts", ignorenulls=True).alias("alts"))
    out = g.select(
        *locus, "reads", F.concat(F.array(F.lit("ref")), "alts").alias("alleles"), F.transform("g", lambda x: F.concat(x["a1"].cast("string"), F.lit("/"), x["a2"].cast("string"))).alias("genotypes"), F.transform("g", lambda x: x["lp"]).alias("raw")
    )
    return _normalised(out, locus)


def heterozygous_factor(ref: Column, alts: Column, snv: float = 1.0, indel: float = 1.0) -> Column:
    """The first factor where all alleles are single bases, else the second."""
    return F.when((F.length(ref) == 1) & ~F.exists(alts, lambda a: F.length(a) != 1), float(snv)).otherwise(float(indel))


def genotype_order(n_alleles: int, ploidy: int = 2) -> list[tuple[int, ...]]:
    return [(i,) for i in range(n_alleles)] if ploidy == 1 else [(a, b) for b in range(n_alleles) for a in range(b + 1)]


# --- alleles --------------------------------------------------------------


def atomize(variants: DataFrame) -> DataFrame:
    """Single-base changes and trimmed indels: contig, pos, ref, alt, ids (joined by ;, sorted).

    ``variants``: contig, pos (0-based), ref, alts array, id. Alternatives of a multi-base change of equal
    length fall into their differing bases; others are trimmed of what they share with the reference.
    """
    each = variants.select("contig", "pos", "id", "ref", F.explode("alts").alias("alt")).where("ref <> alt")
    same = each.where(F.length("ref") == F.length("alt"))
    bases = same.select("contig", "pos", "id", F.posexplode(F.arrays_zip(F.split("ref", "").alias("r"), F.split("alt", "").alias("a"))).alias("k", "z"))
    bases = bases.where(F.col("z")["r"] != F.col("z")["a"]).select("contig", (F.col("pos") + F.col("k")).alias("pos"), F.col("z")["r"].alias("ref"), F.col("z")["a"].alias("alt"), "id")
    other = each.where(F.length("ref") != F.length("alt")).withColumn("t", trim_alleles("ref", "alt"))
    other = other.select("contig", (F.col("pos") + F.col("t")["before"]).alias("pos"), F.col("t")["ref"].alias("ref"), F.col("t")["alt"].alias("alt"), "id")
    out = bases.unionByName(other)
    return out.groupBy("contig", "pos", "ref", "alt").agg(F.array_join(F.array_sort(F.collect_set(F.col("id").cast("string"))), ";").alias("ids"))


def merge_alleles(atoms: DataFrame) -> DataFrame:
    """One row a (contig, pos, ref): ordered distinct alternatives and joined ids."""
    ids = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("ids", ";"))))), ";")
    return atoms.groupBy("contig", "pos", "ref").agg(F.array_sort(F.collect_set("alt")).alias("alts"), ids.alias("ids"))


def add_context_base(variants: DataFrame, contigs: DataFrame, width: int = tiles.WIDTH) -> DataFrame:
    """Where an allele is empty, the base before it leads all alleles (VCF needs one).

    ``contigs``: whole ones (contig, seq) or tiles. Rows on other contigs are left out, and so are rows with an
    empty allele at position 0, which have no base before them.
    """
    cut = tiles.of(contigs, width=width)
    known = variants.join(cut.select("contig").distinct(), "contig", "left_semi").withColumn("_empty", (F.col("ref") == "") | F.exists("alts", lambda a: a == ""))
    full = known.where(~F.col("_empty")).select("contig", "pos", "ref", "alts")
    x = tiles.letters_at(known.where("_empty"), cut, F.col("pos") - 1, width, "inner")
    base = F.col("letter")
    return full.unionByName(x.select("contig", (F.col("pos") - 1).alias("pos"), F.concat(base, "ref").alias("ref"), F.transform("alts", lambda a: F.concat(base, a)).alias("alts")))


def expand_indel(seq: str, pos: int, ref: str, alt: str) -> tuple[int, str, str] | None:
    """An indel with one empty allele, grown over the repeats round it; None where it reaches the sequence's end."""
    if bool(ref) == bool(alt):
        return pos, ref, alt
    unit = ref or alt
    left = 0
    while pos - left - 1 >= 0 and seq[pos - left - 1] == unit[-1 - left % len(unit)]:
        left += 1
    end = pos + len(ref)
    right = 0
    while end + right < len(seq) and seq[end + right] == unit[right % len(unit)]:
        right += 1
    if pos - left <= 0 or end + right >= len(seq):
        return None
    before, after = seq[pos - left : pos], seq[end : end + right]
    return pos - left, before + ref + after, before + alt + after


def expand_indels(variants: DataFrame, contigs: DataFrame, width: int = tiles.WIDTH) -> DataFrame:
    """:func:`expand_indel` over rows contig, pos, ref, alt, on whole contigs or tiles.

    Indels that outgrow a tile are carried on to the next one. The letters grown over repeat the
    indel's own, so that none are carried along.
    """
    cut = tiles.of(contigs, width=width)
    key = ["contig", "pos", "ref", "alt"]
    known = variants.select(*key).join(cut.select("contig").distinct(), "contig", "left_semi")
    open_ = (F.col("ref") == "") != (F.col("alt") == "")
    indels = known.where(open_)
    before = tiles.repeat_reach(indels.distinct(), cut, True, width).withColumnRenamed("reach", "left")
    after = tiles.repeat_reach(indels.distinct(), cut, False, width).withColumnRenamed("reach", "right")
    x = indels.join(before, key).join(after, key).where("left is not null and right is not null")
    unit = F.when(F.col("ref") == "", F.col("alt")).otherwise(F.col("ref"))
    times = lambda n: F.ceil(F.col(n) / F.length(unit)).cast("int")
    head = F.when(F.col("left") > 0, F.substring(F.repeat(unit, times("left")), (-F.col("left")).cast("int"), F.col("left").cast("int"))).otherwise("")
    tail = F.substring(F.repeat(unit, times("right")), F.lit(1), F.col("right").cast("int"))
    grown = x.select("contig", (F.col("pos") - F.col("left")).alias("pos"), F.concat(head, "ref", tail).alias("ref"), F.concat(head, "alt", tail).alias("alt"))
    return known.where(~open_).unionByName(grown)


def check_reference(variants: DataFrame, contigs: DataFrame, width: int = tiles.WIDTH) -> DataFrame:
    """Rows whose reference allele is not what the contig (whole or in tiles) reads."""
    bad = tiles.mismatches(variants, tiles.of(contigs, width=width), width)
    same = [variants[c].eqNullSafe(bad[c]) for c in ("contig", "pos", "ref")]
    return variants.join(bad, same[0] & same[1] & same[2], "left_semi")


def split_genotype_counts(calls: DataFrame, truth: DataFrame) -> DataFrame:
    """Confusion by variant class: kind, truth, call, n. Keys contig, pos, ref, alt; gt text a/b."""

    def state(gt: Column) -> Column:
        a, b = F.split(gt, "/")[0], F.split(gt, "/")[1]
        return F.when((a == "0") & (b == "0"), "hom_ref").when(a == b, "hom_alt").otherwise("het")

    kind = F.when(F.length("ref") == F.length("alt"), "SNP").when(F.length("ref") > F.length("alt"), "DEL").otherwise("INS")
    x = truth.select("contig", "pos", "ref", "alt", state(F.col("gt")).alias("truth")).join(calls.select("contig", "pos", "ref", "alt", state(F.col("gt")).alias("call")), ["contig", "pos", "ref", "alt"])
    return x.groupBy(kind.alias("kind"), "truth", "call").agg(F.count(F.lit(1)).alias("n"))


def confusion_scores(counts: DataFrame) -> DataFrame:
    """kind, class, precision, recall, f1; undefined ones are null."""
    classes = ["hom_ref", "het", "hom_alt"]
    wide = counts.groupBy("kind").agg(*[F.sum(F.when((F.col("truth") == t) & (F.col("call") == c), F.col("n")).otherwise(0)).alias(f"{t}__{c}") for t in classes for c in classes])
    rows = []
    for k in classes:
        hit = F.col(f"{k}__{k}")
        called, true = sum(F.col(f"{t}__{k}") for t in classes), sum(F.col(f"{k}__{c}") for c in classes)
        p, r = F.try_divide(hit, called), F.try_divide(hit, true)
        rows.append(F.struct(F.lit(k).alias("class"), p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1")))
    return wide.select("kind", F.explode(F.array(*rows)).alias("x")).select("kind", "x.*")


CLASSES = ["hom_ref", "het", "hom_alt"]


def factor_breaks(diploid_calls: DataFrame, truth: DataFrame, locus: list[str] = LOCUS) -> DataFrame:
    """locus, kind, truth, hom, at: where a locus's call changes with the heterozygous factor.

    ``diploid_calls``: :func:`diploid` at a factor of 1, loci of one alternative; ``truth``: locus, kind, truth (hom_ref, het or hom_alt).
    Homozygous genotypes gain n ln(factor), so that a locus is het for factors up to (not with) exp(at) and hom, its likelier homozygous genotype, beyond.
    At the break itself the reference wins over het, and het over the alternative.
    """
    two = diploid_calls.where(F.size("log_probs") == 3)
    g = lambda i: F.get("log_probs", F.lit(i))
    hom = F.when(g(0) >= g(2), "hom_ref").otherwise("hom_alt")
    at = (g(1) - F.greatest(g(0), g(2))) / F.col("reads")
    return two.select(*locus, hom.alias("hom"), at.alias("at")).join(truth.select(*locus, "kind", "truth"), locus)


def factor_sweep(breaks: DataFrame, digits: int = 9) -> DataFrame:
    """kind, factor, f1_hom_ref, f1_het, f1_hom_alt, mean_f1 for factors just above each break, by running counts over the breaks.

    ``factor`` is the break (to ``digits`` digits of its logarithm); the row holds up to the next one, and a row of factor 0 comes first. F1 of a class without truth
    or calls is null, as is 0/0 of precision and recall; the mean leaves nulls out.
    """
    # Read five times below, and costly where it comes from calls.
    breaks = materialize(breaks, "breaks")
    points = breaks.groupBy("kind", F.round("at", digits).alias("at")).agg(*[F.sum(F.when((F.col("truth") == t) & (F.col("hom") == h), 1).otherwise(0)).alias(f"{t}__{h}") for t in CLASSES for h in ("hom_ref", "hom_alt")])
    # A locus without a het chance is homozygous whatever the factor: it is at minus infinity, and so before all others.
    start = breaks.select("kind").distinct().select("kind", F.lit(float("-inf")).alias("at"), *[F.lit(0).cast("long").alias(c) for c in points.columns[2:]])
    points = points.unionByName(start).groupBy("kind", "at").agg(*[F.sum(c).alias(c) for c in points.columns[2:]])
    names = points.columns[2:]
    finite = points.where(F.col("at") > float("-inf"))
    run = running(points, ["kind"], ["at"], score_buckets(finite, "at"), {f"_{c}": F.col(c) for c in names})
    totals = breaks.groupBy("kind").agg(*[F.sum(F.when(F.col("truth") == t, 1).otherwise(0)).alias(f"n_{t}") for t in CLASSES])
    x = run.join(F.broadcast(totals), "kind")
    done = {(t, h): F.col(f"_{t}__{h}") + F.col(f"{t}__{h}") for t in CLASSES for h in ("hom_ref", "hom_alt")}
    calls = done | {(t, "het"): F.col(f"n_{t}") - done[t, "hom_ref"] - done[t, "hom_alt"] for t in CLASSES}
    f1 = {}
    for c in CLASSES:
        hit, called = calls[c, c], sum(calls[t, c] for t in CLASSES)
        f1[c] = F.when((called > 0) & (F.col(f"n_{c}") > 0) & (hit > 0), 2 * hit / (called + F.col(f"n_{c}")))
    scored = x.select("kind", F.exp("at").alias("factor"), *[v.alias(f"f1_{c}") for c, v in f1.items()])
    some = F.filter(F.array(*[f"f1_{c}" for c in CLASSES]), lambda v: v.isNotNull())
    return scored.withColumn("mean_f1", F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, v: a + v) / F.size(some)))


def best_factors(sweep: DataFrame) -> DataFrame:
    """kind, factor, mean_f1: the smallest break from which the mean F1 is greatest."""
    return sweep.groupBy("kind").agg(F.max_by(F.struct("factor", "mean_f1"), F.struct("mean_f1", (-F.col("factor")).alias("_less"))).alias("b")).select("kind", "b.factor", "b.mean_f1")


# --- haplotypes -----------------------------------------------------------


def merge_haploid_calls(diploid_calls: DataFrame, hap1: DataFrame, hap2: DataFrame) -> DataFrame:
    """Diploid calls phased by two haploid ones, by (contig, pos, ref, alt).

    gl arrays are log10: of genotypes 0/0, 0/1, 1/1 and of alleles 0, 1. A homozygous call stays. A heterozygous
    one takes the likelier phase of its alleles; where a haploid call is missing it becomes the likelier homozygous one.
    """
    key = ["contig", "pos", "ref", "alt"]
    x = diploid_calls.join(hap1.select(*key, F.col("gl").alias("g1")), key, "left").join(hap2.select(*key, F.col("gl").alias("g2")), key, "left")
    g, a, b = F.col("gl"), F.col("g1"), F.col("g2")
    het = (F.get(g, F.lit(1)) > F.get(g, F.lit(0))) & (F.get(g, F.lit(1)) >= F.get(g, F.lit(2)))
    homo = F.when(F.get(g, F.lit(2)) > F.get(g, F.lit(0)), "1/1").otherwise("0/0")
    p = [F.pow(F.lit(10.0), F.get(a, F.lit(i))) * F.pow(F.lit(10.0), F.get(b, F.lit(j))) for i, j in ((0, 0), (0, 1), (1, 0), (1, 1))]
    total = p[0] + F.greatest(p[1], p[2]) + p[3]
    probs = F.array(p[0] / total, F.greatest(p[1], p[2]) / total, p[3] / total)
    phased = F.when(F.get(probs, F.lit(1)) >= F.greatest(F.get(probs, F.lit(0)), F.get(probs, F.lit(2))), F.when(p[1] >= p[2], "0|1").otherwise("1|0")).when(F.get(probs, F.lit(2)) > F.get(probs, F.lit(0)), "1|1").otherwise("0|0")
    both = a.isNotNull() & b.isNotNull()
    return x.select(*key, F.when(~het, homo).when(both, phased).otherwise(homo).alias("gt"), F.when(het & both, probs).alias("probs"))


def unmatched_haploid(diploid_calls: DataFrame, hap: DataFrame) -> DataFrame:
    """Haploid calls that the diploid source lacks; an error for the merge unless forced."""
    return hap.join(diploid_calls, ["contig", "pos", "ref", "alt"], "left_anti")


def complex_variants(variants: DataFrame) -> DataFrame:
    """Rows of which some alternative, trimmed, still replaces bases by other bases."""
    t = lambda a: trim_alleles(F.col("ref"), a)
    return variants.where(F.exists("alts", lambda a: (t(a)["ref"] != "") & (t(a)["alt"] != "") & ~((F.length(t(a)["ref"]) == 1) & (F.length(t(a)["alt"]) == 1))))


def split_haplotypes(reads: DataFrame) -> DataFrame:
    """Reads with a haplotype tag; the sink partitions by it."""
    return reads.where("hp is not null").select("read_id", "hp")
