"""Text formats: readers with fixed schemas, and rows or lines for writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions.expr import genotype_fields, log1m, natural_key, strand_from_text, strand_to_text, text_to_bool

#: Columns of the formats.
BED_METHYL = "chrom string, start long, end long, name string, score int, strand string, thick_start long, thick_end long, rgb string, cov long, pct double"
MAPPING_SUMMARY = (
    "read_id string, pct_identity double, num_align long, num_match long, num_del long, num_ins long, read_pct_coverage double, chrom string, strand string, start long, end long, "
    "query_start long, query_end long, map_sig_start long, map_sig_end long, sig_len long, map_num int"
)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids: one a line, or a tab-separated table with a ``read_id`` column; a first line that is no header is an id."""
    lines = spark.read.text(path, wholetext=False).where("value <> ''")
    head = lines.limit(1).collect()
    fields = head[0]["value"].split("\t") if head else []
    if "read_id" in fields:
        return spark.read.csv(path, sep="\t", header=True).select("read_id").distinct()
    return lines.select(F.split("value", "\t")[0].alias("read_id")).distinct()


def bed_sites(spark: SparkSession, path: str, ignore_strand: bool = False) -> DataFrame:
    """Distinct chrm, pos, strand of records with six fields or more."""
    x = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 6)
    strand = F.lit(None).cast("int") if ignore_strand else strand_from_text(F.col("f")[5])
    return x.select(F.col("f")[0].alias("chrm"), F.col("f")[1].cast("long").alias("pos"), strand.alias("strand")).distinct()


def bed_scores(spark: SparkSession, path: str) -> DataFrame:
    """chrm, pos, strand, score; of repeated sites the last line counts."""
    x = spark.read.text(path).select(F.split("value", "\t").alias("f"), F.monotonically_increasing_id().alias("line")).where(F.size("f") >= 6)
    return x.groupBy(F.col("f")[0].alias("chrm"), F.col("f")[1].cast("long").alias("pos"), strand_from_text(F.col("f")[5]).alias("strand")).agg(F.max_by(F.col("f")[4].cast("double"), "line").alias("score"))


def dense_scores(sites: DataFrame, scores: DataFrame) -> DataFrame:
    """Every site's score, 0 where none is given."""
    return sites.join(scores, ["chrm", "pos", "strand"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def bed_methyl(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.csv(path, sep="\t", schema=BED_METHYL)
    return x.select("chrom", F.col("start").alias("pos"), strand_from_text("strand").alias("strand"), "cov", "pct")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.csv(path, schema="chrm string, strand string, pos long, is_mod string")
    return x.select("chrm", strand_from_text("strand").alias("strand"), "pos", text_to_bool("is_mod").alias("is_mod"))


def mapping_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=MAPPING_SUMMARY)


def sequencing_summary(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema, nullValue="NA")


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """contig, pos (0-based), id, ref, alts, qual, info map, format map of the first sample."""
    x = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f"))
    f = F.col("f")
    some = lambda i: F.when(F.get(f, F.lit(i)) != ".", F.get(f, F.lit(i)))
    return x.select(
        f[0].alias("contig"), (f[1].cast("long") - 1).alias("pos"), some(2).alias("id"), f[3].alias("ref"), F.split(f[4], ",").alias("alts"), some(5).cast("double").alias("qual"),
        F.str_to_map(F.coalesce(some(7), F.lit("")), F.lit(";"), F.lit("=")).alias("info"),
        F.when(F.size(f) > 9, F.map_from_arrays(F.split(F.get(f, F.lit(8)), ":"), F.split(F.get(f, F.lit(9)), ":"))).alias("sample"),
    )


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, seq: records split at ``>``, so a record is a row however many lines it has."""
    x = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    lines = F.split("value", "\n")
    return x.select(F.split(lines[0], r"\s")[0].alias("name"), F.array_join(F.slice(lines, 2, F.size(lines)), "").alias("seq"))


# --- rows for writers -----------------------------------------------------


def bed_methyl_lines(calls: DataFrame) -> DataFrame:
    """mod_base, value: a line a site and mod, from columns of ``mods.binary_threshold``."""
    pct = F.format_string("%.1f", F.rint(F.col("prop") * 1000) / 10)
    s, e = F.col("pos").cast("string"), (F.col("pos") + 1).cast("string")
    cov = F.col("valid_reads").cast("string")
    line = F.concat_ws("\t", "chrm", s, e, F.lit("."), F.least("valid_reads", F.lit(1000)).cast("string"), strand_to_text("strand"), s, e, F.lit("0,0,0"), cov, pct)
    return calls.select("mod_base", "chrm", "pos", line.alias("value"))


def write_by_mod(lines: DataFrame, path: str) -> None:
    """A folder a modified base, lines in genome order within files."""
    ordered = lines.repartitionByRange(natural_key("chrm"), "pos").sortWithinPartitions(natural_key("chrm"), "pos")
    ordered.select("mod_base", "value").write.partitionBy("mod_base").text(path)


def wiggle_lines(calls: DataFrame) -> DataFrame:
    """mod_base, strand, chrm, pos, value: variable-step lines, positions from 1, proportions."""
    line = F.concat_ws(" ", (F.col("pos") + 1).cast("string"), F.format_string("%.6f", "prop"))
    return calls.select("mod_base", "strand", "chrm", "pos", line.alias("value"))


def mod_vcf_lines(calls: DataFrame, ref: str = "C") -> DataFrame:
    """chrm, pos, value: a record a site with a FORMAT field a modified base."""
    by_site = calls.groupBy("chrm", "pos", "strand", "reads", "valid_reads").agg(F.array_sort(F.collect_list(F.struct("mod_base", "prop"))).alias("m"))
    keys, values = F.array_join(F.transform("m", lambda x: x["mod_base"]), ":"), F.array_join(F.transform("m", lambda x: F.format_string("%.4f", x["prop"])), ":")
    info = F.concat(F.lit("DP="), F.col("reads").cast("string"), F.lit(";STRD="), strand_to_text("strand"))
    line = F.concat_ws("\t", "chrm", (F.col("pos") + 1).cast("string"), F.lit("."), F.lit(ref), F.lit("."), F.lit("."), F.lit("."), info, F.concat(F.lit("VALID_DP:"), keys), F.concat(F.col("valid_reads").cast("string"), F.lit(":"), values))
    return by_site.select("chrm", "pos", line.alias("value"))


def vcf_header(contigs: list[tuple[str, int]], sample: str = "SAMPLE") -> list[str]:
    return ["##fileformat=VCFv4.2", *(f"##contig=<ID={n},length={k}>" for n, k in contigs), "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])]


def fastq_lines(reads: DataFrame) -> DataFrame:
    """A record a row of value: missing quality is ! throughout."""
    q = F.coalesce("qual", F.repeat(F.lit("!"), F.length("seq")))
    return reads.select(F.concat(F.lit("@"), "read_id", F.lit("\n"), "seq", F.lit("\n+\n"), q).alias("value"))


def fasta_lines(reads: DataFrame) -> DataFrame:
    return reads.select(F.concat(F.lit(">"), "read_id", F.lit("\n"), "seq").alias("value"))


def sam_lines(alignments: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Text alignments: read_id, chrm, pos (0-based), strand, mapq, cigar, seq, qual, tags (array of text); where there is a map_num, mappings after the first are supplementary. ``keep``: columns beside value."""
    dna = F.translate("seq", "U", "T")
    flag = F.when(F.col("strand") == -1, 16).otherwise(0)
    flag = (flag + F.when(F.col("map_num") > 0, 2048).otherwise(0) if "map_num" in alignments.columns else flag).cast("string")
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), "\t")
    core = F.concat_ws("\t", "read_id", flag, "chrm", (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), dna, F.coalesce("qual", F.lit("*")))
    return alignments.select(*keep, F.when(tags == "", core).otherwise(F.concat(core, F.lit("\t"), tags)).alias("value"))


def per_read_mods(calls: DataFrame, reads: DataFrame, names: DataFrame) -> DataFrame:
    """uuid, chrm, pos, strand (text), mod_log_prob, can_log_prob, mod_base (long name)."""
    can = calls.groupBy("chrm", "pos", "strand", "read_id").agg(log1m(F.sum(F.exp("score"))).alias("can_log_prob"), F.collect_list(F.struct("mod_base", "score")).alias("m"))
    x = can.select("*", F.explode("m").alias("x")).join(reads, "read_id")
    x = x.select("uuid", "chrm", "pos", strand_to_text("strand").alias("strand"), F.col("x.score").alias("mod_log_prob"), "can_log_prob", F.col("x.mod_base").alias("mod_base"))
    return x.join(F.broadcast(names), "mod_base").select("uuid", "chrm", "pos", "strand", "mod_log_prob", "can_log_prob", F.col("mod_long_name").alias("mod_base"))


def per_read_variants(calls: DataFrame, reads: DataFrame, loci: DataFrame) -> DataFrame:
    """uuid, chrm, strand (text), pos, ref_seq, alt_seq, alt_log_prob, ref_log_prob; chrm where ``loci`` and strand where ``reads`` have it."""
    ref = calls.groupBy("locus", "read_id").agg(log1m(F.sum(F.exp("score"))).alias("ref_log_prob"), F.collect_list(F.struct("alt_seq", "score")).alias("a"))
    x = ref.select("*", F.explode("a").alias("x")).join(reads, "read_id").join(loci, "locus")
    chrm = ["chrm"] if "chrm" in loci.columns else []
    strand = [strand_to_text("strand").alias("strand")] if "strand" in reads.columns else []
    return x.select("uuid", *chrm, *strand, "pos", "ref_seq", F.col("x.alt_seq").alias("alt_seq"), F.col("x.score").alias("alt_log_prob"), "ref_log_prob")


def version_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(natural_key(column), column)


def vcf_lines(calls: DataFrame) -> DataFrame:
    """contig, pos, value: a genotype record a locus, from contig, pos (0-based), ref, alts, reads, genotypes, log_probs, gt."""
    f = genotype_fields(F.col("log_probs"))
    x = calls.withColumn("_f", f)
    gl = F.array_join(F.transform("_f.gl", lambda v: F.format_string("%.2f", F.rint(v * 100) / 100 + 0.0)), ",")
    sample = F.concat_ws(":", F.get("genotypes", F.col("gt")), F.col("reads").cast("string"), F.col("_f.gq").cast("string"), gl, F.array_join("_f.pl", ","))
    line = F.concat_ws("\t", "contig", (F.col("pos") + 1).cast("string"), F.lit("."), "ref", F.array_join("alts", ","), F.coalesce(F.col("_f.qual").cast("string"), F.lit(".")), F.lit("."), F.concat(F.lit("DP="), F.col("reads").cast("string")), F.lit("GT:DP:GQ:GL:PL"), sample)
    return x.select("contig", "pos", line.alias("value"))


def mapping_summary_lines(summary: DataFrame) -> DataFrame:
    """Tab-separated rows of a mapping summary, columns in the fixed order; percentages with two decimals."""
    names = [c.split()[0] for c in MAPPING_SUMMARY.split(", ")]
    kinds = {c.split()[0]: c.split()[1] for c in MAPPING_SUMMARY.split(", ")}
    cell = lambda n: F.coalesce(F.format_string("%.2f", F.rint(F.col(n) * 100) / 100) if kinds[n] == "double" else F.col(n).cast("string"), F.lit("NA"))
    return summary.select(F.concat_ws("\t", *[cell(n) for n in names]).alias("value"))


# --- whole files ----------------------------------------------------------


def wiggle_files(calls: DataFrame) -> DataFrame:
    """file, part, chrm, pos, value: the lines of a file for each modified base and strand.

    In order of part, natural order of chrm, and pos they are the file: a track line (part 0), and by contig a line that opens it (pos -1) and its values.
    """
    strand = F.when(F.col("strand") == 1, "fwd_strand").otherwise("rev_strand")
    lines = wiggle_lines(calls).withColumn("file", F.concat_ws(".", "mod_base", strand)).withColumn("part", F.lit(1))
    fields = ["file", "part", "chrm", "pos", "value"]
    opens = lines.select("file", "part", "chrm").distinct().select("file", "part", "chrm", F.lit(-1).cast("long").alias("pos"), F.concat(F.lit("variableStep chrom="), "chrm", F.lit(" span=1")).alias("value"))
    name = F.concat(F.lit('"'), "file", F.lit('"'))
    track = lines.select("file").distinct().select("file", F.lit(0).alias("part"), F.lit("").alias("chrm"), F.lit(-1).cast("long").alias("pos"), F.concat(F.lit("track type=wiggle_0 name="), name, F.lit(" description="), name).alias("value"))
    return lines.select(fields).unionByName(opens).unionByName(track)


def sam_file(alignments: DataFrame, contigs: DataFrame) -> DataFrame:
    """part, number, chrm, pos, value: header lines, contigs in the order of their table's ``number``, and alignments by position.

    ``contigs``: chrm, chrm_len, number. In order of part, number, pos and value the lines are a file sorted by coordinate.
    """
    rows = alignments.join(contigs.select("chrm", "number"), "chrm")
    lines = sam_lines(rows, ("number", "chrm", "pos"))
    head = contigs.select(F.lit(1).alias("part"), "number", "chrm", F.lit(-1).cast("long").alias("pos"), F.concat(F.lit("@SQ\tSN:"), "chrm", F.lit("\tLN:"), F.col("chrm_len").cast("string")).alias("value"))
    first = contigs.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(-1).cast("long").alias("number"), F.lit("").alias("chrm"), F.lit(-1).cast("long").alias("pos"), F.lit("@HD\tVN:1.6\tSO:coordinate").alias("value"))
    fields = ["part", "number", "chrm", "pos", "value"]
    return lines.withColumn("part", F.lit(2)).select(fields).unionByName(head.select(fields)).unionByName(first.select(fields))


def vcf_file(lines: DataFrame, contigs: list[tuple[str, int]], sample: str = "SAMPLE") -> DataFrame:
    """part, number, contig, pos, value: header lines by number, then the records of :func:`vcf_lines` by contig and position."""
    spark = lines.sparkSession
    head = spark.createDataFrame([(0, i, "", -1, x) for i, x in enumerate(vcf_header(contigs, sample))], "part int, number long, contig string, pos long, value string")
    body = lines.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("number"), F.col("contig").cast("string").alias("contig"), F.col("pos").cast("long").alias("pos"), "value")
    return head.unionByName(body)


def read_references(reads: DataFrame) -> DataFrame:
    """A record a row of value: the reference that a read's first mapping covers. ``reads``: read_id, map_num, ref_seq; filtered before."""
    return reads.where("map_num = 0").select(F.concat(F.lit(">"), "read_id", F.lit("\n"), "ref_seq").alias("value"))


def write_ordered(lines: DataFrame, order: list, path: str, by: str | None = None) -> None:
    """Text files whose parts, one after another by name, are the lines in order; with ``by``, a folder for each of its values."""
    out = lines.repartitionByRange(*([by] if by else []), *order).sortWithinPartitions(*([by] if by else []), *order)
    writer = out.select(*([by] if by else []), "value").write
    (writer.partitionBy(by) if by else writer).text(path)


def in_file_order(chrm: str = "chrm") -> list:
    """The order of :func:`wiggle_files`."""
    return ["part", natural_key(chrm), chrm, "pos"]
