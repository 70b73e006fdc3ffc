"""Scalar expressions over sequences, probabilities, alignments and records, as Spark columns.

numpy's meaning of infinities and NaN is kept where Spark's own functions give null or an
error; see :func:`log1m`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")

#: Letters of a nucleotide code and what each stands for.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T",
    "B": "CGT", "D": "AGT", "H": "ACT", "K": "GT", "M": "AC", "N": "ACGT", "R": "AG", "S": "CG", "V": "ACG", "W": "AT", "Y": "CT",
}

#: Steepness and middle of the logistic weight of a read.
EXPIT_K, EXPIT_X0 = 30.0, 0.8


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- sequences ------------------------------------------------------------


def complement(seq) -> Column:
    return F.translate(_c(seq), "ACGT", "TGCA")


def reverse_complement(seq) -> Column:
    return F.translate(F.reverse(_c(seq)), "ACGT", "TGCA")


def rna_to_dna(seq) -> Column:
    return F.translate(_c(seq), "U", "T")


def bisulfite(seq, forward: bool = True) -> Column:
    """Unmethylated bases as they read after conversion: C to T, on the other strand G to A."""
    return F.translate(_c(seq), "C", "T") if forward else F.translate(_c(seq), "G", "A")


def motif_regex(motif: str, overlapping: bool = True) -> str:
    body = "".join(f"[{IUPAC[b]}]" if len(IUPAC[b]) > 1 else b for b in motif)
    return f"(?=({body}))" if overlapping else body


def motif_complement(motif: str) -> str:
    """The motif as it reads on the other strand."""
    back = {frozenset(v): k for k, v in IUPAC.items()}
    swap = str.maketrans("ACGT", "TGCA")
    return "".join(back[frozenset(IUPAC[b].translate(swap))] for b in reversed(motif))


def motif_positions(seq, motif: str, offset: int = 0) -> Column:
    """0-based positions of the motif's ``offset``-th base, overlapping hits included."""
    s, n = _c(seq), len(motif)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.length(s) - n, F.lit(0))), lambda i: F.substring(s, i + 1, F.lit(n)).rlike("^" + motif_regex(motif, False) + "$"))
    return F.transform(starts, lambda i: i + offset)


def homopolymer_length(seq) -> Column:
    """Longest run of one letter."""
    runs = F.regexp_extract_all(_c(seq), F.lit(r"(?s)(.)\1*"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def trim_alleles(ref, alt) -> Column:
    """Struct (ref, alt, before, after): the common prefix off first, then the common suffix."""
    r, a = _c(ref), _c(alt)
    n = F.least(F.length(r), F.length(a))
    steps = lambda k: F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    same = lambda k, test: F.aggregate(steps(k), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, i: F.struct((s["on"] & test(i)).alias("on"), (s["n"] + (s["on"] & test(i)).cast("int")).alias("n")), lambda s: s["n"])
    before = same(n, lambda i: F.substring(r, i, F.lit(1)) == F.substring(a, i, F.lit(1)))
    r2, a2 = F.substring(r, before + 1, F.length(r)), F.substring(a, before + 1, F.length(a))
    after = same(F.least(F.length(r2), F.length(a2)), lambda i: F.substring(r2, F.length(r2) - i + 1, F.lit(1)) == F.substring(a2, F.length(a2) - i + 1, F.lit(1)))
    cut = lambda s: F.substring(s, F.lit(1), F.length(s) - after)
    return F.struct(cut(r2).alias("ref"), cut(a2).alias("alt"), before.alias("before"), after.alias("after"))


# --- probabilities --------------------------------------------------------


def log1m(total) -> Column:
    """ln(1 - total): -inf at 1, NaN above."""
    s = _c(total)
    return F.when(s > 1, F.lit(NAN)).when(s == 1, F.lit(-INF)).otherwise(F.log1p(-s))


def safe_ln(x) -> Column:
    x = _c(x)
    return F.when(x < 0, F.lit(NAN)).when(x == 0, F.lit(-INF)).otherwise(F.log(x))


def round_half_even(x, digits: int = 0) -> Column:
    scale = 10.0**digits
    return F.rint(_c(x) * scale) / scale


def phred(log_p) -> Column:
    """-10 log10(1 - e^lp); certain calls are infinite."""
    lp = _c(log_p)
    rest = -F.expm1(lp)
    return F.when(rest <= 0, F.lit(INF)).otherwise(-10 * F.log10(rest))


def array_max_or(a: Column, default: float) -> Column:
    return F.coalesce(F.array_max(a), F.lit(default))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def logsumexp(values) -> Column:
    v = _c(values)
    top = F.array_max(v)
    return F.when(top == -INF, F.lit(-INF)).otherwise(top + F.log(array_sum(F.transform(v, lambda x: F.exp(x - top)))))


def softmax(values) -> Column:
    v = _c(values)
    z = logsumexp(v)
    return F.transform(v, lambda x: F.exp(x - z))


def log_softmax(values) -> Column:
    v = _c(values)
    z = logsumexp(v)
    return F.transform(v, lambda x: x - z)


def llrs_to_log_probs(llrs) -> Column:
    """Reference first: ref = -log1p(sum e^-llr), alternatives ref - llr."""
    v = _c(llrs)
    ref = -F.log1p(array_sum(F.transform(v, lambda x: F.exp(-x))))
    return F.concat(F.array(ref), F.transform(v, lambda x: ref - x))


def log_factorial(n) -> Column:
    """ln n! of a whole number, to about 1e-14: a table up to 15, the asymptotic series beyond."""
    x = _c(n).cast("double")
    z = x + 1
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    return F.when(x < 16, F.get(small, x.cast("int"))).otherwise(series)


def expit(p, k: float = EXPIT_K, x0: float = EXPIT_X0) -> Column:
    return 1 / (1 + F.exp(-k * (_c(p) - x0)))


def mean_qscore(quality) -> Column:
    codes = F.transform(F.split(_c(quality), ""), lambda q: F.ascii(q) - 33)
    return F.when(F.length(_c(quality)) > 0, F.aggregate(codes, F.lit(0), lambda s, x: s + x) / F.length(_c(quality)))


# --- numeric arrays -------------------------------------------------------


def array_median(values) -> Column:
    s = F.array_sort(_c(values))
    n = F.size(s)
    half = (n / 2).cast("int")
    return F.when(n == 0, F.lit(None)).when(n % 2 == 1, F.get(s, half)).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2)


#: Fixed value: a normal distribution's standard deviation in median absolute deviations.
MAD_SCALE = 1.4826


def med_mad(values) -> Column:
    v = _c(values)
    med = array_median(v)
    return F.struct(med.alias("med"), (array_median(F.transform(v, lambda x: F.abs(x - med))) * MAD_SCALE).alias("mad"))


def normalise_signal(values) -> Column:
    mm = med_mad(values)
    return F.transform(_c(values), lambda x: (x - mm["med"]) / mm["mad"])


def to_picoamps(dacs, offset, range_, digitisation) -> Column:
    return F.transform(_c(dacs), lambda x: (x + _c(offset)) * _c(range_) / _c(digitisation))


def stored_posterior(values, offset, scale) -> Column:
    return F.transform(_c(values), lambda x: (x + _c(offset)) * _c(scale))


def rolling_windows(values, k: int) -> Column:
    v = _c(values)
    return F.when(F.size(v) >= k, F.transform(F.sequence(F.lit(1), F.size(v) - k + 1), lambda i: F.slice(v, i, k))).otherwise(F.array().cast("array<array<double>>"))


def run_lengths(values) -> Column:
    """Array of struct (value, n) over runs of equal neighbours."""
    # Arrays are walked by zips: what stands inside a lambda would be made again for each element.
    v = _c(values)
    n = F.size(v)
    before = F.concat(F.slice(v, 1, 1), F.slice(v, 1, F.greatest(n - 1, F.lit(0))))
    changes = F.zip_with(v, before, lambda x, y: F.struct(x.alias("value"), (~x.eqNullSafe(y)).alias("new")))
    starts = F.filter(F.transform(changes, lambda z, i: F.struct(z["value"].alias("value"), F.when(z["new"] | (i == 0), i).alias("at"))), lambda z: z["at"].isNotNull())
    ends = F.concat(F.slice(F.transform(starts, lambda z: z["at"]), 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(n))
    runs = F.zip_with(starts, ends, lambda z, end: F.struct(z["value"].alias("value"), (end - z["at"]).alias("n")))
    return F.when(n > 0, runs).otherwise(F.slice(runs, 1, 0))


# --- alignments -----------------------------------------------------------

#: Codes of alignment operations.
CIGAR = {"M": 0, "I": 1, "D": 2, "N": 3, "S": 4, "H": 5, "P": 6, "=": 7, "X": 8}


def cigar_ops(cigar) -> Column:
    """Array of struct (len, op) from text."""
    parts = F.regexp_extract_all(_c(cigar), F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.substring(p, F.lit(1), F.length(p) - 1).cast("int").alias("len"), F.right(p, F.lit(1)).alias("op")))


def cigar_total(ops: Column, letters: str) -> Column:
    return F.aggregate(F.filter(ops, lambda o: o["op"].isin(*letters)), F.lit(0), lambda s, o: s + o["len"])


def percent_identity(ops: Column) -> Column:
    """Aligned and equal bases of all but clips; M counts as equal."""
    return 100.0 * cigar_total(ops, "M=") / (cigar_total(ops, "MIDNP=X"))


def alignment_stats(ops: Column) -> Column:
    return F.struct(cigar_total(ops, "MIDNP=X").alias("num_align"), cigar_total(ops, "M=").alias("num_match"), cigar_total(ops, "D").alias("num_del"), cigar_total(ops, "I").alias("num_ins"))


def sam_flag(strand, supplementary=None) -> Column:
    return F.when(_c(strand) == -1, 16).otherwise(0) + (F.when(_c(supplementary), 2048).otherwise(0) if supplementary is not None else 0)


def reference_to_query(ops: Column) -> Column:
    """Query position of each reference position and of the end; a deletion repeats the current one."""
    start = F.struct(F.array().cast("array<int>").alias("map"), F.lit(0).alias("q"))

    def step(a, o):
        n, q = o["len"], a["q"]
        rows = lambda f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array().cast("array<int>"))
        grown = F.when(o["op"].isin("M", "=", "X"), F.concat(a["map"], rows(lambda i: q + i))).when(o["op"].isin("D", "N"), F.concat(a["map"], rows(lambda i: q))).otherwise(a["map"])
        return F.struct(grown.alias("map"), (q + F.when(o["op"].isin("M", "=", "X", "I"), n).otherwise(0)).alias("q"))

    return F.aggregate(F.filter(ops, lambda o: ~o["op"].isin("S", "H")), start, step, lambda a: F.concat(a["map"], F.array(a["q"])))


# --- records --------------------------------------------------------------


def strand_to_text(strand) -> Column:
    return F.when(_c(strand) == 1, "+").when(_c(strand) == -1, "-").otherwise(".")


def strand_from_text(strand) -> Column:
    return F.when(_c(strand) == "+", 1).when(_c(strand) == "-", -1)


#: Words that stand for true and false.
TRUE_WORDS, FALSE_WORDS = ["y", "yes", "t", "true", "on", "1"], ["n", "no", "f", "false", "off", "0"]


def text_to_bool(text) -> Column:
    t = F.lower(_c(text))
    return F.when(t.isin(TRUE_WORDS), True).when(t.isin(FALSE_WORDS), False).otherwise(F.raise_error(F.concat(F.lit("not a truth value: "), _c(text))).cast("boolean"))


def natural_key(name, width: int = 12) -> Column:
    """Sort key in which runs of digits order by value (to ``width`` digits)."""
    padded = F.regexp_replace(_c(name), r"(\d+)", "0" * width + "$1")
    return F.regexp_replace(padded, r"0*(\d{" + str(width) + r"})(?!\d)", "$1")


def info_map(info) -> Column:
    """Map of ``k=v;flag`` text; flags map to null."""
    return F.str_to_map(_c(info), F.lit(";"), F.lit("="))


def format_map(format_, sample) -> Column:
    return F.map_from_arrays(F.split(_c(format_), ":"), F.split(_c(sample), ":"))


def seconds_text(samples, rate) -> Column:
    return F.format_string("%.6f", _c(samples) / _c(rate))


def encode_position(offset, pos, strand) -> Column:
    return _c(offset) + 2 * _c(pos) + F.when(_c(strand) == -1, 1).otherwise(0)


def genotype_fields(log_probs: Column) -> Column:
    """Struct of VCF fields from an array of natural log genotype probabilities.

    gl: log10, not below -999; pl: phred-scaled and relative to the best, at most 999; gq: the
    second smallest pl; qual: of the reference genotype, null at 0.
    """
    gl = F.transform(log_probs, lambda x: F.greatest(x / F.log(F.lit(10.0)), F.lit(-999.0)))
    raw = F.transform(gl, lambda x: F.rint(-10 * x))
    low = F.array_min(raw)
    pl = F.transform(raw, lambda x: F.least(x - low, F.lit(999.0)).cast("int"))
    best = F.aggregate(F.sequence(F.lit(0), F.size(gl) - 1), F.lit(0), lambda b, i: F.when(F.get(gl, i) > F.get(gl, b), i).otherwise(b))
    qual = F.rint(F.abs(-10 * F.get(gl, F.lit(0))))
    return F.struct(gl.alias("gl"), pl.alias("pl"), F.get(F.array_sort(pl), F.lit(1)).alias("gq"), F.when(qual > 0, qual.cast("int")).alias("qual"), best.cast("int").alias("best"))


def trim_padding(ref, alt) -> Column:
    """Struct (ref, alt, before): the common suffix off first, then the prefix, one base of each kept."""
    r, a = _c(ref), _c(alt)
    steps = lambda k: F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    shared = lambda x, y, at: F.aggregate(steps(F.least(F.length(x), F.length(y)) - 1), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, i: F.struct((s["on"] & at(x, y, i)).alias("on"), (s["n"] + (s["on"] & at(x, y, i)).cast("int")).alias("n")), lambda s: s["n"])
    from_end = lambda x, y, i: F.substring(x, F.length(x) - i + 1, F.lit(1)) == F.substring(y, F.length(y) - i + 1, F.lit(1))
    from_start = lambda x, y, i: F.substring(x, i, F.lit(1)) == F.substring(y, i, F.lit(1))
    after = shared(r, a, from_end)
    r2, a2 = F.substring(r, F.lit(1), F.length(r) - after), F.substring(a, F.lit(1), F.length(a) - after)
    before = shared(r2, a2, from_start)
    return F.struct(F.substring(r2, before + 1, F.length(r2)).alias("ref"), F.substring(a2, before + 1, F.length(a2)).alias("alt"), before.alias("before"))


def trim_padding_all(ref, alts) -> Column:
    """Struct (ref, alts, before): what all alleles share off, the suffix first, then the prefix, one base of each kept."""
    r, many = _c(ref), _c(alts)
    letter = lambda x, i: F.substring(x, i, F.lit(1))
    steps = lambda k: F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))

    def shared(x: Column, others: Column, same) -> Column:
        """How many letters all alleles share from one end: up to the first that some allele has differently."""
        shortest = F.least(F.length(x), F.array_min(F.transform(others, F.length)))
        differ = F.filter(steps(shortest - 1), lambda i: F.exists(others, lambda y: ~same(x, y, i)))
        return F.coalesce(F.array_min(differ) - 1, F.greatest(shortest - 1, F.lit(0)))

    after = shared(r, many, lambda x, y, i: letter(x, F.length(x) - i + 1) == letter(y, F.length(y) - i + 1))
    cut = lambda x: F.substring(x, F.lit(1), F.length(x) - after)
    r2, many2 = cut(r), F.transform(many, cut)
    before = shared(r2, many2, lambda x, y, i: letter(x, i) == letter(y, i))
    rest = lambda x: F.substring(x, before + 1, F.length(x))
    return F.struct(rest(r2).alias("ref"), F.transform(many2, rest).alias("alts"), before.alias("before"))


def block_starts(ref_to_query: Column, moves_until: Column) -> Column:
    """Block of each reference position: that of its query base, from the running number of blocks a base."""
    return F.transform(ref_to_query, lambda q: F.get(moves_until, q))


def query_starts(moves: Column) -> Column:
    """Blocks at which bases begin, from a table of moves (1 where a block begins a base), and the number of blocks last."""
    at = F.filter(F.transform(moves, lambda m, i: F.when(m == 1, i)), lambda i: i.isNotNull())
    return F.concat(at, F.array(F.size(moves)))
