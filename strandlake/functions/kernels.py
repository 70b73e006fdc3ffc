"""Numeric kernels over transition scores of a flip-flop model, in numpy.

A block of scores has a column for every allowed transition between ``2 n`` states, n flips
and n flops of n bases: into flip t from state f at ``t * 2n + f``; into a flop from itself or its own
flip at ``n * 2n + f``. Further columns hold modified-base scores. Kernels see one read at a
time and run inside Arrow batches of rows, so tables of reads scale by rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BASES = "ACGT"


def transitions(n: int) -> np.ndarray:
    """Column of each (to, from) pair of states, -1 where there is none."""
    out = np.full((2 * n, 2 * n), -1, np.int64)
    flips, states = np.arange(n), np.arange(2 * n)
    out[:n] = flips[:, None] * 2 * n + states[None, :]
    out[n + flips, n + flips] = 2 * n * n + n + flips
    out[n + flips, flips] = 2 * n * n + flips
    return out


def bases_of_columns(columns: int) -> int:
    """n for 2 n (n + 1) transition columns."""
    n = int(round((np.sqrt(1 + 2 * columns) - 1) / 2))
    if 2 * n * (n + 1) != columns:
        raise ValueError(f"{columns} columns are not those of a flip-flop model")
    return n


def _square(scores: np.ndarray, n: int) -> np.ndarray:
    """(block, to, from) scores with -inf for what is not allowed."""
    cols = transitions(n)
    out = scores[:, np.maximum(cols, 0)]
    out[:, cols < 0] = -np.inf
    return out


def viterbi(scores: np.ndarray, n: int = 4) -> tuple[float, np.ndarray]:
    """Best score and its states, one before each block and one at the end. Of equals the lowest state leads into a flip; a flop stays."""
    square = _square(scores, n)
    now, back = np.zeros(2 * n), np.zeros((len(scores), 2 * n), np.int64)
    flops = np.arange(n, 2 * n)
    for i, s in enumerate(square):
        reach = s + now[None, :]
        back[i] = reach.argmax(1)
        stays = reach[flops, flops] >= reach[flops, flops - n]
        back[i, flops] = np.where(stays, flops, flops - n)
        now = reach[np.arange(2 * n), back[i]]
    path = np.zeros(len(scores) + 1, np.int64)
    path[-1] = now.argmax()
    for i in range(len(scores) - 1, -1, -1):
        path[i] = back[i, path[i + 1]]
    return float(now.max()), path


def run_starts(path: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, path[1:] != path[:-1]])


def decode(scores: np.ndarray, n: int = 4) -> tuple[str, np.ndarray]:
    """Called bases and the block at which each begins."""
    _, path = viterbi(scores, n)
    at = run_starts(path)
    return "".join(BASES[s % n] for s in path[at]), at


def forward_backward(scores: np.ndarray, n: int = 4) -> np.ndarray:
    """Posterior log-probability of every transition column of every block (rows sum to one in probability)."""
    square = _square(scores, n)
    blocks = len(scores)
    fwd, bwd = np.zeros((blocks + 1, 2 * n)), np.zeros((blocks + 1, 2 * n))
    fwd[0] = -np.log(2 * n)
    for i in range(blocks):
        x = np.logaddexp.reduce(square[i] + fwd[i][None, :], axis=1)
        fwd[i + 1] = x - np.logaddexp.reduce(x)
    for i in range(blocks - 1, -1, -1):
        x = np.logaddexp.reduce(square[i] + bwd[i + 1][:, None], axis=0)
        bwd[i] = x - np.logaddexp.reduce(x)
    joint = square + fwd[:-1, None, :] + bwd[1:, :, None]
    joint -= np.logaddexp.reduce(joint.reshape(blocks, -1), axis=1)[:, None, None]
    cols = transitions(n)
    out = np.full((blocks, 2 * n * (n + 1)), -np.inf)
    out[:, cols[cols >= 0]] = joint[:, cols >= 0]
    return out


def flip_flop(seq: np.ndarray, n: int = 4) -> np.ndarray:
    """States of a base sequence: a base that repeats a flip is its flop."""
    out = np.asarray(seq, np.int64).copy()
    for i in range(1, len(out)):
        if out[i] == out[i - 1]:
            out[i] += n
    return out


def encode(seq: str) -> np.ndarray:
    return np.frombuffer(seq.translate(str.maketrans(BASES, "\x00\x01\x02\x03")).encode("latin-1"), np.uint8).astype(np.int64)


def score_sequence(scores: np.ndarray, seq: np.ndarray, start: int, end: int, all_paths: bool = False, n: int = 4, mod_columns: np.ndarray | None = None) -> float:
    """Score of a base sequence over blocks [start, end), by its best path or by all paths.

    The first base holds before the window's first block. ``mod_columns`` gives, for each base,
    a further column that is added on the step into it (the first base takes none). Over a base, arriving at
    block j is ``S_j + reduce(prev_i + step_i - S_i, i <= j)`` with S the running sum of stays, so a base is one accumulate.
    """
    seq = np.asarray(seq, np.int64)
    blocks = end - start
    slack = blocks - len(seq) + 2
    if slack < 1:
        raise ValueError("a window needs a block a step")
    cols, states, window = transitions(n), flip_flop(seq, n), scores[start:end]
    accumulate = (np.logaddexp if all_paths else np.maximum).accumulate
    now = np.r_[0.0, np.cumsum(window[: slack - 1, cols[states[0], states[0]]], dtype=np.float64)]
    for k in range(1, len(seq)):
        part = window[k - 1 : k - 1 + slack]
        step = part[:, cols[states[k], states[k - 1]]].astype(np.float64)
        if mod_columns is not None:
            step = step + part[:, mod_columns[k]]
        stays = np.r_[0.0, np.cumsum(part[1:, cols[states[k], states[k]]], dtype=np.float64)]
        now = stays + accumulate(now + step - stays)
    return float(now[-1])


def best_starts(scores: np.ndarray, seq: np.ndarray, n: int = 4) -> tuple[float, np.ndarray]:
    """Best score and the block at which each base begins, the number of blocks last; the first base takes the first block as a stay."""
    seq = np.asarray(seq, np.int64)
    blocks, length = len(scores), len(seq)
    if blocks < length:
        raise ValueError("fewer blocks than bases")
    cols, states = transitions(n), flip_flop(seq, n)
    slack = blocks - length + 1
    now = np.cumsum(scores[:slack, cols[states[0], states[0]]], dtype=np.float64)
    begins = [np.zeros(slack, np.int64)]
    for k in range(1, length):
        part = scores[k : k + slack]
        step = now + part[:, cols[states[k], states[k - 1]]]
        stays = np.r_[0.0, np.cumsum(part[1:, cols[states[k], states[k]]], dtype=np.float64)]
        lead = step - stays
        best = np.maximum.accumulate(lead)
        # A later step only counts if it is strictly better, else the base stays.
        fresh = np.r_[True, lead[1:] > best[:-1]]
        begins.append(np.maximum.accumulate(np.where(fresh, np.arange(slack), 0)))
        now = stays + best
    starts = np.zeros(length + 1, np.int64)
    starts[length] = blocks
    at = slack - 1
    for k in range(length - 1, -1, -1):
        at = begins[k][at]
        starts[k] = at + k
    return float(now[-1]), starts


def signal_band(breaks: np.ndarray, levels: np.ndarray, half_width: int | None) -> np.ndarray:
    """(2, signal length): first and one past the last base that a position may belong to.

    Round the given breakpoints by ``half_width`` bases; pinned where a level is unknown; both edges
    monotone; opened until neighbouring positions share or follow on.
    """
    bases = len(levels)
    if len(breaks) != bases + 1:
        raise ValueError("breakpoints must be one more than levels")
    owner = np.repeat(np.arange(bases), np.diff(breaks))
    reach = bases if half_width is None else half_width
    low, high = np.clip(owner - reach, 0, bases), np.clip(owner + reach + 1, 0, bases)
    pinned = np.isnan(np.asarray(levels, float))[owner]
    low[pinned], high[pinned] = owner[pinned], owner[pinned] + 1
    low = np.maximum.accumulate(low)
    high = np.minimum.accumulate(high[::-1])[::-1].copy()
    while (gaps := np.flatnonzero(low[1:] >= high[:-1])).size:
        low[gaps + 1] = np.maximum(low[gaps + 1] - 1, 0)
        high[gaps] = np.minimum(high[gaps] + 1, bases)
    return np.stack([low, high])


def sequence_band(band: np.ndarray) -> np.ndarray:
    """The same band seen from the bases: first and one past the last signal position of each."""
    bases = np.arange(band[1, -1])
    # Edges are monotone: a base opens where the upper edge first passes it and closes where the lower edge does.
    opens = np.searchsorted(band[1], bases, "right")
    closes = np.searchsorted(band[0], bases, "right")
    return np.stack([opens, closes])


def check_band(band: np.ndarray, along: int | None = None, across: int | None = None) -> None:
    """Raises where a band is empty, not monotone, or does not span its two lengths."""
    problems = {
        "does not start at 0": band[0, 0] != 0, "has an empty place": (band[1] <= band[0]).any(), "starts go back": (np.diff(band[0]) < 0).any(), "ends go back": (np.diff(band[1]) < 0).any(),
        "has another length": along is not None and band.shape[1] != along, "ends elsewhere": across is not None and band[1, -1] != across,
    }
    if wrong := [k for k, bad in problems.items() if bad]:
        raise ValueError("band " + ", ".join(wrong))


def constrained_decode(scores: np.ndarray, allowed: list[str], band: np.ndarray, n: int = 4) -> str:
    """The likeliest sequence with one of ``allowed[i]``'s bases at position i, each for a block or more within its band.

    ``band``: (2, positions) of block ranges. Raises where no path stays within.
    """
    length, blocks = len(allowed), len(scores)
    may = np.zeros((length, 2 * n), bool)
    for i, letters in enumerate(allowed):
        for b in letters:
            may[i, [BASES.index(b), BASES.index(b) + n]] = True
    may[0, n:] = False
    square = _square(scores, n)
    stay = square[:, np.arange(2 * n), np.arange(2 * n)]
    np.einsum("bii->bi", square)[:] = -np.inf  # a step changes the state
    inside = (np.arange(blocks)[:, None] >= band[0]) & (np.arange(blocks)[:, None] < band[1])
    now = np.full((length, 2 * n), -np.inf)
    now[0, may[0]] = stay[0, may[0]]
    came = np.zeros((blocks, length, 2 * n), np.int8)
    for t in range(1, blocks):
        into = now[:-1, None, :] + square[t][None]
        source = into.argmax(2)
        moved = np.full_like(now, -np.inf)
        moved[1:] = np.take_along_axis(into, source[:, :, None], 2)[:, :, 0]
        kept = now + stay[t]
        came[t] = -1
        came[t, 1:] = np.where(moved[1:] > kept[1:], source, -1)
        now = np.where(may & inside[t][:, None], np.maximum(moved, kept), -np.inf)
    state, i = int(now[-1].argmax()), length - 1
    if now[-1, state] == -np.inf:
        raise ValueError("no path within the band")
    out = [state]
    for t in range(blocks - 1, 0, -1):
        if (source := came[t, i, state]) >= 0:
            state, i = int(source), i - 1
            out.append(state)
    if i:
        raise ValueError("the path leaves the band")
    return "".join(BASES[s % n] for s in reversed(out))


def mod_llr(scores: np.ndarray, seq: str, at: int, mod_column: int, can_column: int, start: int, end: int, columns: dict[str, int], all_paths: bool = False) -> float:
    """Canonical less modified score of the base at ``at`` of a context over blocks [start, end). ``columns``: the canonical column of each base."""
    can = np.array([columns[b] for b in seq])
    mod = can.copy()
    can[at], mod[at] = can_column, mod_column
    e = encode(seq)
    return score_sequence(scores, e, start, end, all_paths, mod_columns=can) - score_sequence(scores, e, start, end, all_paths, mod_columns=mod)


def variant_llrs(scores: np.ndarray, ref: str, alts: list[str], start: int, end: int, all_paths: bool = False) -> list[float]:
    """Reference less alternative score of whole context sequences; alternatives that need more blocks than there are score -inf."""
    base = score_sequence(scores, encode(ref), start, end, all_paths)
    return [base - (score_sequence(scores, encode(a), start, end, all_paths) if len(a) <= end - start + 1 else -np.inf) for a in alts]


def single_indels(seq: str, longest: int = 1) -> Iterator[tuple[int, str, str]]:
    """(position, ref, alt) of every deletion and insertion of up to ``longest`` bases."""
    for k in range(1, longest + 1):
        yield from ((i, seq[i : i + k], "") for i in range(len(seq) - k + 1))
        yield from ((i, "", "".join(x)) for i in range(len(seq) + 1) for x in itertools.product(BASES, repeat=k))


def context_combinations(distances: list[int], cap: int = 16) -> list[tuple[int, ...]]:
    """Index sets of neighbouring variants, nearest first, at most ``cap`` of them; the empty set leads."""
    order = sorted(range(len(distances)), key=lambda i: (distances[i], i))
    sets = (c for k in range(len(order) + 1) for c in itertools.combinations(order, k))
    ranked = sorted(itertools.islice(sets, 1 << min(len(order), 12)), key=lambda c: (sum(distances[i] for i in c), len(c), c))
    return ranked[:cap]


def mods_softmax(weights: np.ndarray, groups: list[int]) -> np.ndarray:
    """Log-probabilities of modified-base columns, normalised within each canonical base's group of columns."""
    out = np.array(weights, np.float64)
    for a, b in itertools.pairwise(np.r_[0, np.cumsum(groups)]):
        out[:, a:b] -= np.logaddexp.reduce(out[:, a:b], axis=1)[:, None]
    return out


def interpolate_positions(moves: np.ndarray) -> np.ndarray:
    """Signal position of every base, evenly between bases that have one (NaN where not); the tail repeats the last."""
    m = np.asarray(moves, np.float64)
    known = np.flatnonzero(~np.isnan(m))
    if not len(known):
        return np.zeros(len(m), np.int64)
    return np.floor(np.interp(np.arange(len(m)), known, m[known])).astype(np.int64)


def remap_signal(ref_to_query: np.ndarray, query_to_signal: np.ndarray) -> np.ndarray:
    """Signal position of each reference base through its query base."""
    return query_to_signal[np.minimum(ref_to_query, len(query_to_signal) - 1)]


def decode_table(reads: DataFrame) -> DataFrame:
    """read_id, bases, n_bases, score, posterior_max: calls from 40-column blocks made of each row's ``values``.

    Values are cut into blocks by a sliding window, as many as there are values; reads with fewer than one give no base.
    """
    kind = reads.schema["read_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v in batch.column("values").to_pylist():
                x = np.array(v or [], np.float64)
                if not len(x):
                    rows.append(("", 0, None, None))
                    continue
                blocks = np.stack([np.resize(np.roll(x, -i), 40) for i in range(len(x))]) * 4
                score, _ = viterbi(blocks)
                seq, _ = decode(blocks)
                rows.append((seq, len(seq), round(score, 6), round(float(forward_backward(blocks).max()), 6)))
            yield pa.RecordBatch.from_arrays([batch.column("read_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.float64(), pa.float64()), strict=True))], names=["read_id", "bases", "n_bases", "score", "posterior_max"])

    return reads.select("read_id", "values").mapInArrow(run, f"read_id {kind}, bases string, n_bases long, score double, posterior_max double")
