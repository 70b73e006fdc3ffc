import itertools

import numpy as np
import pytest

from strandlake.functions import kernels as k

R = np.random.default_rng(5)
COLS = k.transitions(4)


def cell_score(scores, seq, start, end, all_paths, mod_columns=None):
    """Recurrence cell by cell."""
    states = k.flip_flop(np.array(seq))
    join = np.logaddexp if all_paths else max
    n, blocks = len(seq), end - start
    f = np.full((blocks + 1, n), -np.inf)
    f[0, 0] = 0.0
    for t in range(blocks):
        row = scores[start + t]
        for i in range(n):
            stay = f[t, i] + row[COLS[states[i], states[i]]]
            step = -np.inf
            if i:
                step = f[t, i - 1] + row[COLS[states[i], states[i - 1]]] + (row[mod_columns[i]] if mod_columns is not None else 0)
            f[t + 1, i] = join(stay, step)
    return f[blocks, n - 1]


@pytest.mark.parametrize("all_paths", [False, True])
def test_scores_match_the_cell_recurrence(all_paths):
    for n, blocks in ((1, 4), (2, 2), (5, 9), (6, 5), (8, 30)):
        scores = R.normal(size=(blocks + 4, 46))
        seq = R.integers(0, 4, n)
        seq[1:2] = seq[:1]
        mods = R.integers(40, 46, n)
        assert np.isclose(k.score_sequence(scores, seq, 2, 2 + blocks, all_paths), cell_score(scores, seq, 2, 2 + blocks, all_paths))
        assert np.isclose(k.score_sequence(scores, seq, 2, 2 + blocks, all_paths, mod_columns=mods), cell_score(scores, seq, 2, 2 + blocks, all_paths, mods))
    with pytest.raises(ValueError):
        k.score_sequence(scores, np.zeros(9, int), 0, 6)


def paths(blocks):
    for p in itertools.product(range(8), repeat=blocks + 1):
        if all(COLS[b, a] >= 0 for a, b in itertools.pairwise(p)):
            yield p


def test_viterbi_and_posteriors_by_enumeration():
    scores = R.normal(size=(3, 40))
    total = {p: sum(scores[i, COLS[b, a]] for i, (a, b) in enumerate(itertools.pairwise(p))) for p in paths(3)}
    best, path = k.viterbi(scores)
    assert np.isclose(best, max(total.values())) and np.isclose(total[tuple(path)], best)
    z = np.logaddexp.reduce(list(total.values()))
    want = np.full((3, 40), -np.inf)
    for p, s in total.items():
        for i, (a, b) in enumerate(itertools.pairwise(p)):
            want[i, COLS[b, a]] = np.logaddexp(want[i, COLS[b, a]], s - z)
    assert np.allclose(k.forward_backward(scores), want)
    assert np.allclose(np.exp(k.forward_backward(scores)).sum(1), 1)
    assert k.decode(np.zeros((4, 40)))[0] == "A"


def test_best_starts_by_enumeration():
    for n, blocks in ((3, 6), (4, 4), (1, 3)):
        scores, seq = R.normal(size=(blocks, 40)), R.integers(0, 4, n)
        st = k.flip_flop(seq)
        best = -np.inf
        for cut in itertools.combinations(range(1, blocks), n - 1):
            at = [0, *cut, blocks]
            s = sum(scores[t, COLS[st[i], st[i - 1 if i and t == at[i] else i]]] for i in range(n) for t in range(at[i], at[i + 1]))
            if s > best:
                best, want = s, at
        score, starts = k.best_starts(scores, seq)
        assert np.isclose(score, best) and starts.tolist() == want


def test_constrained_decode_by_enumeration():
    scores = R.normal(size=(5, 40))
    band = np.array([[0, 0, 1], [4, 5, 5]])
    allowed = ["AC", "ACGT", "GT"]
    best = None
    for seq in itertools.product(*allowed):
        ff = [[k.BASES.index(b)] for b in seq]
        states = k.flip_flop(np.array([x[0] for x in ff]))
        for cut in itertools.combinations(range(1, 5), 2):
            at = [0, *cut, 5]
            if any(not (band[0, i] <= t < band[1, i]) for i in range(3) for t in range(at[i], at[i + 1])):
                continue
            s = sum(scores[t, COLS[states[i], states[i - 1 if i and t == at[i] else i]]] for i in range(3) for t in range(at[i], at[i + 1]))
            if best is None or s > best[0]:
                best = (s, "".join(seq))
    assert k.constrained_decode(scores, allowed, band) == best[1]
    with pytest.raises(ValueError):
        k.constrained_decode(scores, allowed, np.array([[0, 0, 0], [1, 1, 1]]))


def test_bands():
    breaks = np.array([0, 2, 5, 5, 9, 12])
    band = k.signal_band(breaks, np.zeros(5), 1)
    k.check_band(band, 12, 5)
    assert band[0, 0] == 0 and band[1, -1] == 5
    pinned = k.signal_band(breaks, np.array([0, np.nan, 0, 0, 0]), 2)
    assert (pinned[:, 2:5] == [[1] * 3, [2] * 3]).all()
    seq = k.sequence_band(band)
    k.check_band(seq, 5, 12)
    for b in range(5):
        inside = [s for s in range(12) if band[0, s] <= b < band[1, s]]
        assert (seq[0, b], seq[1, b]) == (inside[0], inside[-1] + 1)
    assert (k.signal_band(breaks, np.zeros(5), None) == [[0] * 12, [5] * 12]).all()
    with pytest.raises(ValueError, match="go back"):
        k.check_band(np.array([[0, 2, 1], [3, 4, 5]]))


def test_calls_from_scores():
    scores = R.normal(size=(20, 44))
    cols = {"A": 40, "C": 41, "G": 42, "T": 43}
    llr = k.mod_llr(scores, "ACGTA", 1, 43, 41, 2, 14, cols)
    assert np.isclose(llr, -k.mod_llr(scores, "ACGTA", 1, 41, 43, 2, 14, cols))
    (same, other) = k.variant_llrs(scores, "ACG", ["ACG", "A" * 30], 0, 10)
    assert same == 0 and other == np.inf
    assert len(list(k.single_indels("ACG"))) == 3 + 4 * 4
    sets = k.context_combinations([3, 1, 2], cap=5)
    assert sets[0] == () and sets[1] == (1,) and len(sets) == 5
    p = k.mods_softmax(R.normal(size=(4, 5)), [2, 3])
    assert np.allclose(np.exp(p[:, :2]).sum(1), 1) and np.allclose(np.exp(p[:, 2:]).sum(1), 1)
    assert k.interpolate_positions(np.array([0, np.nan, 4, np.nan])).tolist() == [0, 2, 4, 4]
    assert k.bases_of_columns(40) == 4
