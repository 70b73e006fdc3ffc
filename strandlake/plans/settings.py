"""Parameters that change results, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from strandlake.functions.expr import IUPAC

#: Outputs of a main run.
OUTPUTS = ("basecalls", "mod_basecalls", "mappings", "per_read_refs", "signal_mappings", "per_read_variants", "variants", "variant_mappings", "per_read_mods", "mods", "mod_mappings")
#: Outputs that need others first.
IMPLIED = {"variants": "per_read_variants", "variant_mappings": "per_read_variants", "mods": "per_read_mods", "mod_mappings": "per_read_mods"}
MOD_FORMATS = ("bedmethyl", "modvcf", "wiggle")


@dataclass(frozen=True)
class RunSettings:
    outputs: tuple[str, ...] = ("basecalls",)
    num_reads: int | None = None
    mod_motifs: tuple[tuple[str, int], ...] = ()
    mod_aggregate_method: str = "binary_threshold"
    mod_binary_threshold: float = 0.8
    mod_context_bases: int = 15
    mod_all_paths: bool = False
    mod_min_prob: float = 0.0
    ref_mod_threshold: float = 0.0
    mod_output_formats: tuple[str, ...] = ("bedmethyl",)
    write_mod_log_probs: bool = False
    haploid: bool = False
    heterozygous_factors: tuple[float, float] = (1.0, 1.0)
    context_min_alt_prob: float = 0.0
    max_indel_size: int = 50
    variant_context_bases: tuple[int, int] = (15, 30)
    variant_all_paths: bool = False
    edge_buffer: int = 0
    ref_length_range: tuple[int | None, int | None] = (None, None)
    percent_identity: float | None = None
    percent_coverage: float | None = None
    rna: bool = False
    resolved: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self):
        if unknown := set(self.outputs) - set(OUTPUTS):
            raise ValueError(f"unknown outputs: {sorted(unknown)}")
        if unknown := set(self.mod_output_formats) - set(MOD_FORMATS):
            raise ValueError(f"unknown formats: {sorted(unknown)}")
        if self.rna and any("variant" in o for o in self.outputs):
            raise ValueError("variants are not called from RNA")
        all_ = dict.fromkeys(self.outputs)
        all_.update(dict.fromkeys(IMPLIED[o] for o in self.outputs if o in IMPLIED))
        object.__setattr__(self, "resolved", tuple(o for o in OUTPUTS if o in all_))


def check_motifs(motifs: list[tuple[str, int]]) -> None:
    """Raises where two motifs may claim one base, or a position lies outside its motif."""
    for m, at in motifs:
        if not 0 <= at < len(m) or set(m) - set(IUPAC):
            raise ValueError(f"bad motif {m}:{at}")
        if len(IUPAC[m[at]]) != 1:
            raise ValueError(f"the base of {m}:{at} must be one letter")
    for i, (m, a) in enumerate(motifs):
        for n, b in motifs[:i]:
            ks = range(max(-a, -b), min(len(m) - a, len(n) - b))
            if all(set(IUPAC[m[a + k]]) & set(IUPAC[n[b + k]]) for k in ks):
                raise ValueError(f"motifs {m} and {n} overlap")


def split_alphabet(alphabet: str, collapsed: str) -> dict[str, list[str]]:
    """Modified labels of each canonical base, from an alphabet and the canonical letter each stands for."""
    if len(alphabet) != len(collapsed):
        raise ValueError("alphabets must be of one length")
    out: dict[str, list[str]] = {c: [] for c in dict.fromkeys(collapsed)}
    for a, c in zip(alphabet, collapsed, strict=True):
        if a != c:
            out[c].append(a)
    return out


def motif_words(motif: str) -> list[str]:
    """All concrete words of a motif."""
    return ["".join(x) for x in product(*(IUPAC[b] for b in motif))]
