"""How many runs of targets synonymous shuffles give: the exact distribution by a recurrence, or a sample where its states are too many.

A shuffle permutes codons within each family's places, so a family of n places and t targets has its targets on any t of them alike. A run is two or more
consecutive targets. Places are revealed one after another: the next one of a family holds a target with probability (targets left) / (places left),
whatever the order, so places that can be in no run are never revealed, the rest may be taken segment by segment in any order, and a family's count is
summed out with its last place. The state is the number of targets used of each open family, how the run stands (none, one target, counted) and
the runs so far; mass that reaches the observed number leaves it, and is the p value."""

from __future__ import annotations

import numpy as np

CELLS = 10_000_000  # of all steps of a gene's recurrence together; beyond, shuffles are drawn
STATE = 1_000_000  # cells of a state, 8 MB
DRAWN = 4_000_000  # marks of a block of shuffles


def count(mark: np.ndarray) -> np.ndarray:
    """Runs of two or more along the last axis."""
    pair = mark[..., 1:] & mark[..., :-1]
    return pair.sum(-1) - (pair[..., 1:] & pair[..., :-1]).sum(-1)


def segments(group: np.ndarray, able: np.ndarray) -> list[np.ndarray]:
    """The groups of each stretch of two or more places that can hold targets; those of few groups first, then by the groups."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], able.astype(np.int8), [0]])))
    found = [group[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= 2]
    return sorted(found, key=lambda s: (sorted(set(s.tolist()), reverse=True), len(s)))


def steps(parts: list[np.ndarray], targets: np.ndarray, sure: np.ndarray, seen: int) -> tuple[int, int]:
    """(cells of all steps, of the largest state) that tail would take."""
    last = {g: i for i, g in enumerate(np.concatenate(parts).tolist())} if parts else {}
    used, i, cells, most, size = {}, 0, 0, 0, 3 * seen
    for g in (g for s in parts for g in s.tolist()):
        if not sure[g] and used.get(g, 0) < targets[g]:
            size = size // (used.get(g, 0) + 1) * (used.get(g, 0) + 2)
            used[g] = used.get(g, 0) + 1
        cells, most = cells + size, max(most, size)
        if last[g] == i:
            size //= used.pop(g, 0) + 1
        i += 1
    return cells, most


def tail(parts: list[np.ndarray], places: np.ndarray, targets: np.ndarray, sure: np.ndarray, seen: int) -> float:
    """The probability of seen runs or more, seen > 0; places and targets by group, sure: groups of targets alone."""
    last = {g: i for i, g in enumerate(np.concatenate(parts).tolist())} if parts else {}
    state = np.zeros((*[1] * len(places), 3, seen))
    state[(0,) * state.ndim] = 1.0
    shown, done, i = np.zeros(len(places), int), 0.0, 0
    for part in parts:
        for g in part.tolist():
            if sure[g]:
                off, on = None, state
            else:
                size = state.shape[g]
                p = (targets[g] - np.arange(size)) / (places[g] - shown[g])
                p = p.reshape([size if a == g else 1 for a in range(state.ndim)])
                off, on = state * (1.0 - p), state * p
                pad = [(0, 0)] * state.ndim
                if size <= targets[g]:  # one more may be used than before
                    pad[g] = (0, 1)
                    off = np.pad(off, pad)
                    pad[g] = (1, 0)
                    on = np.pad(on, pad)
                else:  # with all used, none is left: p is 0 there
                    on = np.roll(on, 1, axis=g)
            state = np.zeros_like(on)
            state[..., 1, :] = on[..., 0, :]
            state[..., 2, :] = on[..., 2, :]
            state[..., 2, 1:] += on[..., 1, :-1]
            done += float(on[..., 1, -1].sum())
            if off is not None:
                state[..., 0, :] += off.sum(-2)
            shown[g] += 1
            if last[g] == i:
                state = state.sum(g, keepdims=True)
            i += 1
        state[..., 0, :] = state.sum(-2)  # a stretch ends: no run goes on
        state[..., 1:, :] = 0.0
    return min(1.0, done)


def drawn(mark: np.ndarray, group: np.ndarray, able: np.ndarray, seen: int, permutations: int, rng: np.random.Generator) -> float:
    """The share of shuffles with seen runs or more, the observed order counted among them; blocks of shuffles are drawn at once."""
    where = [np.flatnonzero(able & (group == g)) for g in np.unique(group[able])]
    where = [w for w in where if not mark[w].all()]
    block, above = max(1, DRAWN // max(1, len(mark))), 0
    for first in range(0, permutations, block):
        many = np.repeat(mark[None], min(block, permutations - first), axis=0)
        for w in where:
            many[:, w] = rng.permuted(many[:, w], axis=1)
        above += int((count(many) >= seen).sum())
    return (above + 1) / (permutations + 1)


def test(mark: np.ndarray, group: np.ndarray, permutations: int, seed: list[int]) -> tuple[int, float, bool]:
    """(runs, p, exact) of one gene. mark: which places hold targets; group: the family of each place, from 0."""
    seen = int(count(mark))
    if not seen:
        return 0, 1.0, True
    places, targets = np.bincount(group), np.bincount(group, weights=mark).astype(int)
    able = (targets > 0)[group]
    named = np.flatnonzero(targets)  # the groups with targets alone are numbered on
    number = np.full(len(places), -1)
    number[named] = np.arange(len(named))
    parts = segments(number[group], able)
    places, targets = places[named], targets[named]
    sure = targets == places
    cells, most = steps(parts, targets, sure, seen)
    if cells <= CELLS and most <= STATE and len(named) <= 30:
        return seen, tail(parts, places, targets, sure, seen), True
    return seen, drawn(mark, group, able, seen, permutations, np.random.default_rng(seed)), False
