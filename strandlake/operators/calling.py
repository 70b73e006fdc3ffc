"""Per-read calls from transition scores: modified bases at motifs, sequence variants, markup of reads.

A table of reads has one row a read: read_id, chrm, strand, r_st (0-based), ref (the reference letters it
covers, on its strand), starts (block of each reference position and of the end) and post (blocks by
columns). Kernels run inside Arrow batches; a batch holds whole reads and nothing crosses rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import kernels as k
from strandlake.functions.expr import motif_regex

#: Context bases on each side, for mods, single-base changes and indels; largest indel.
MOD_CONTEXT, SNV_CONTEXT, INDEL_CONTEXT, MAX_INDEL = 15, 15, 30, 50


@dataclass(frozen=True)
class ModModel:
    """Columns after the transitions: of each canonical base, and of each modified base of it."""

    canonical: dict[str, int]
    modified: dict[str, dict[str, int]]


def call_mods(reads: DataFrame, model: ModModel, motifs: list[tuple[str, int]], context: int = MOD_CONTEXT, edge: int = 0, all_paths: bool = False, least_prob: float = 0.0) -> DataFrame:
    """read_id, chrm, pos, strand, mod_base, score (natural log) at motif bases.

    Skips: positions nearer than (or at) ``edge`` of the read's ends, contexts with other letters, contexts with
    fewer blocks than bases. Probabilities of all mods of a base come from their log-likelihood ratios together.
    """
    patterns = [(re.compile(motif_regex(m)), off, m[off]) for m, off in motifs]
    kind = reads.schema["read_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ref, starts, post = r["ref"], r["starts"], np.array(r["post"], np.float64)
                n, done = len(ref), set()
                for pattern, off, base in patterns:
                    for at in (m.start() + off for m in pattern.finditer(ref)):
                        if at in done or not (at > edge and n - at > edge):
                            continue
                        done.add(at)
                        a, b = max(0, at - context), min(n, at + context + 1)
                        seq = ref[a:b]
                        if set(seq) - set(k.BASES) or starts[b] - starts[a] < len(seq):
                            continue
                        names = sorted(model.modified.get(base, {}))
                        llrs = np.array([k.mod_llr(post, seq, at - a, model.modified[base][m], model.canonical[base], starts[a], starts[b], model.canonical, all_paths) for m in names])
                        lps = -np.log1p(np.exp(-llrs).sum()) - llrs
                        pos = r["r_st"] + (at if r["strand"] == 1 else n - 1 - at)
                        out += [(r["read_id"], r["chrm"], pos, r["strand"], m, float(lp)) for m, lp in zip(names, lps, strict=True) if np.exp(lp) >= least_prob]
            yield _batch(out, batch.schema.field("read_id").type, [("chrm", pa.string()), ("pos", pa.int64()), ("strand", pa.int32()), ("mod_base", pa.string()), ("score", pa.float64())])

    return reads.select("read_id", "chrm", "r_st", F.col("strand").cast("int").alias("strand"), "ref", "starts", "post").mapInArrow(run, f"read_id {kind}, chrm string, pos long, strand int, mod_base string, score double")


def _batch(rows: list[tuple], id_type: pa.DataType, fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * (len(fields) + 1)
    types = [id_type, *(t for _, t in fields)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["read_id", *(n for n, _ in fields)])


def reads_with_variants(reads: DataFrame, variants: DataFrame, edge: int = 0, max_indel: int = MAX_INDEL, width: int = 1000) -> DataFrame:
    """Reads with an array of the variants they span: struct (pos, ref, alts), by a binned interval join."""
    from strandlake.operators.intervals import points_in_intervals

    v = variants.select(F.col("contig").alias("chrm"), "pos", F.col("ref").alias("v_ref"), "alts").where(~F.exists("alts", lambda a: F.abs(F.length(a) - F.length("v_ref")) > max_indel))
    spans = reads.select("read_id", "chrm", "r_st", (F.col("r_st") + F.length("ref")).alias("r_en"))
    x = points_in_intervals(spans, v, ["chrm"], "r_st", "r_en", "pos", width).where((F.col("pos") - F.col("r_st") >= edge) & (F.col("r_en") - F.col("pos") - F.length("v_ref") >= edge))
    per = x.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("v_ref").alias("ref"), "alts"))).alias("variants"))
    return reads.join(per, "read_id")


def call_variants(reads: DataFrame, all_paths: bool = False, context_distance: int = 5, combinations: int = 16, snv_context: int = SNV_CONTEXT, indel_context: int = INDEL_CONTEXT) -> DataFrame:
    """read_id, chrm, pos, ref_seq, alt_seq, score of every alternative a read spans.

    Pass one scores each variant alone; pass two adds up, for each allele, the chances over the neighbours'
    combinations (nearest first). Alternatives score ln P from their likelihood ratios together.
    ``reads`` as made by :func:`reads_with_variants`; reverse reads carry their reference on their own strand.
    """
    kind = reads.schema["read_id"].dataType.simpleString()
    flip = str.maketrans("ACGT", "TGCA")

    def edit(ref: str, a: int, b: int, changes: list[tuple[int, str, str]]) -> str:
        out, at = [], a
        for p, r, alt in sorted(changes):
            out += [ref[at:p], alt]
            at = p + len(r)
        return "".join(out) + ref[at:b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ref, starts, post, n = r["ref"], r["starts"], np.array(r["post"], np.float64), len(r["ref"])
                own = []
                for v in r["variants"]:
                    p = v["pos"] - r["r_st"]
                    if r["strand"] == -1:
                        own.append((n - p - len(v["ref"]), v["ref"].translate(flip)[::-1], [x.translate(flip)[::-1] for x in v["alts"]], v))
                    else:
                        own.append((p, v["ref"], v["alts"], v))
                for p, vref, alts, v in own:
                    span = snv_context if all(len(x) == len(vref) for x in alts) else indel_context
                    a, b = max(0, p - span), min(n, p + len(vref) + span)
                    if set(ref[a:b]) - set(k.BASES) or starts[b] - starts[a] < b - a:
                        continue
                    near = [o for o in own if o[3] is not v and (0 <= o[0] - (p + len(vref)) <= context_distance or 0 <= p - (o[0] + len(o[1])) <= context_distance)]
                    sets = k.context_combinations([abs(o[0] - p) for o in near], combinations)
                    totals = np.full(1 + len(alts), -np.inf)
                    for chosen in sets:
                        picks = [near[i] for i in chosen]
                        if any(x[0] < y[0] + len(y[1]) and y[0] < x[0] + len(x[1]) for i, x in enumerate(picks) for y in picks[:i]):
                            continue
                        for alt_choice in _choices([o[2] for o in picks]):
                            others = [(o[0], o[1], x) for o, x in zip(picks, alt_choice, strict=True)]
                            for j, allele in enumerate([vref, *alts]):
                                seq = edit(ref, a, b, [*others, (p, vref, allele)])
                                if 0 < len(seq) <= starts[b] - starts[a] + 1:
                                    totals[j] = np.logaddexp(totals[j], k.score_sequence(post, k.encode(seq), starts[a], starts[b], all_paths))
                    lps = totals - np.logaddexp.reduce(totals)
                    out += [(r["read_id"], r["chrm"], v["pos"], v["ref"], x, float(lp)) for x, lp in zip(v["alts"], lps[1:], strict=True)]
            yield _batch(out, batch.schema.field("read_id").type, [("chrm", pa.string()), ("pos", pa.int64()), ("ref_seq", pa.string()), ("alt_seq", pa.string()), ("score", pa.float64())])

    return reads.select("read_id", "chrm", "r_st", F.col("strand").cast("int").alias("strand"), "ref", "starts", "post", "variants").mapInArrow(run, f"read_id {kind}, chrm string, pos long, ref_seq string, alt_seq string, score double")


def _choices(alts: list[list[str]]) -> list[tuple[str, ...]]:
    return list(itertools.product(*alts))


def mark_mods(reads: DataFrame, calls: DataFrame, threshold: float = 0.0, site_thresholds: DataFrame | None = None) -> DataFrame:
    """read_id, seq, qual: reference letters of each read with its likeliest mods in place, and a quality letter a base.

    A base stays canonical if its log-likelihood ratio is above the threshold (of its site where one is given).
    """
    best = calls.groupBy("read_id", "chrm", "pos", "strand").agg(F.max_by(F.struct("mod_base", "score"), F.struct("score", "mod_base")).alias("b"), F.sum(F.exp("score")).alias("total"))
    llr = F.when(F.col("total") >= 1, float("-inf")).otherwise(F.log1p(-F.col("total")) - F.col("b.score"))
    if site_thresholds is not None:
        best = best.join(site_thresholds.select("chrm", "pos", "strand", F.col("threshold").alias("_t")), ["chrm", "pos", "strand"], "left")
        limit = F.coalesce("_t", F.lit(threshold))
    else:
        limit = F.lit(threshold)
    marks = best.where(llr <= limit).select("read_id", "pos", F.col("b.mod_base").alias("letter"), F.least(F.greatest(F.rint(-10 * F.log10(F.greatest(1 - F.exp("b.score"), F.lit(1e-9)))), F.lit(0.0)), F.lit(40.0)).cast("int").alias("q"))
    per = marks.groupBy("read_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("letter", "q")))).alias("m"))
    x = reads.select("read_id", "r_st", "strand", "ref").join(per, "read_id", "left")
    n = F.length("ref")
    at = F.sequence(F.lit(0), n - 1)
    place = lambda i: F.when(F.col("strand") == 1, F.col("r_st") + i).otherwise(F.col("r_st") + n - 1 - i)
    seq = F.transform(at, lambda i: F.coalesce(F.try_element_at("m", place(i))["letter"], F.substring("ref", i + 1, F.lit(1))))
    qual = F.transform(at, lambda i: F.char(33 + F.coalesce(F.try_element_at("m", place(i))["q"], F.lit(40))))
    return x.select("read_id", F.when(n > 0, F.array_join(seq, "")).otherwise("").alias("seq"), F.when(n > 0, F.array_join(qual, "")).otherwise("").alias("qual"))


def annotate_variants(reads: DataFrame, calls: DataFrame) -> DataFrame:
    """read_id, seq, cigar: reference letters with the likeliest alternatives that do not overlap, and how they map back.

    ``reads`` on the forward strand. Per variant the best allele counts if it is likelier than the reference; of overlapping
    ones the likeliest survives (islands).
    """
    from strandlake.operators.intervals import islands

    per = calls.groupBy("read_id", "chrm", "pos", "ref_seq").agg(F.max_by(F.struct("alt_seq", "score"), F.struct("score", "alt_seq")).alias("b"), F.sum(F.exp("score")).alias("total"))
    won = per.where(F.col("b.score") > F.when(F.col("total") < 1, F.log1p(-F.col("total"))).otherwise(float("-inf"))).select("read_id", F.col("pos").alias("start"), (F.col("pos") + F.greatest(F.length("ref_seq"), F.lit(1))).alias("end"), "ref_seq", "b.alt_seq", "b.score")
    kept = islands(won, ["read_id"]).groupBy("read_id", "island").agg(F.max_by(F.struct("start", "ref_seq", "alt_seq"), F.struct("score", -F.col("start"))).alias("v"))
    lists = kept.groupBy("read_id").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    kind = reads.schema["read_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                seq, ops, at = [], [], 0
                for v in r["vs"] or []:
                    p = v["start"] - r["r_st"]
                    if p < at:
                        continue
                    same = min(len(v["ref_seq"]), len(v["alt_seq"]))
                    seq += [r["ref"][at:p], v["alt_seq"]]
                    ops += [(p - at + same, "M"), (len(v["alt_seq"]) - same, "I"), (len(v["ref_seq"]) - same, "D")]
                    at = p + len(v["ref_seq"])
                seq.append(r["ref"][at:])
                ops.append((len(r["ref"]) - at, "M"))
                merged: list[list] = []
                for n, op in (o for o in ops if o[0]):
                    if merged and merged[-1][1] == op:
                        merged[-1][0] += n
                    else:
                        merged.append([n, op])
                out.append((r["read_id"], "".join(seq), "".join(f"{n}{op}" for n, op in merged)))
            yield _batch(out, batch.schema.field("read_id").type, [("seq", pa.string()), ("cigar", pa.string())])

    return reads.select("read_id", "r_st", "ref").join(lists, "read_id", "left").mapInArrow(run, f"read_id {kind}, seq string, cigar string")
