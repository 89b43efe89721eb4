"""Suffix arrays by linear grouping, for many short strings at once (numpy, in tasks).

Phase 1 forms groups of suffixes that share their longest Lyndon prefix: starting from
groups by first symbol, the groups are processed in descending order; for each suffix of
the group, its previous-smaller pointer finds the nearest suffix to the left that lies in
a smaller group; the suffixes so found move to a new group right after their own, later
the more often they were found. Phase 2 emits the order inside the groups: going up the
suffix array, the suffixes whose next smaller suffix is the current one (the chain of
previous-smaller pointers left of it) take the next free place of their groups. No
symbol is renamed and nothing recurses.

All strings of a batch advance together, one group (phase 1) or one place (phase 2) a
step, so a step is a handful of array operations over all strings.
"""

from __future__ import annotations

import numpy as np


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every run, one after the other."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(total)


def suffix_arrays(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Concatenated suffix arrays (as positions in ``symbols``) of the strings
    ``symbols[bounds[k]:bounds[k + 1]]``. The last symbol of each string must be smaller
    than all its others."""
    n = len(symbols)
    lengths = np.diff(bounds)
    string = np.repeat(np.arange(len(lengths)), lengths)
    base = bounds[:-1]
    sa = np.lexsort((symbols, string))
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    head = np.ones(n, dtype=bool)
    head[1:] = (symbols[sa][1:] != symbols[sa][:-1]) | (string[sa][1:] != string[sa][:-1])
    heads = np.flatnonzero(head)
    group = np.empty(n, np.int64)  # first place of each suffix's group
    group[sa] = heads[np.cumsum(head) - 1]
    size = np.zeros(n, np.int64)
    size[heads] = np.diff(np.append(heads, n))
    prev = np.full(n, -1, np.int64)
    moving = np.zeros(n, dtype=bool)
    floor = base[string]  # first position of each suffix's string

    # phase 1: from the highest group of every string downwards
    cursor = group[sa[bounds[1:] - 1]]
    live = np.arange(len(lengths))
    while len(live):
        gs = cursor[live]
        member = sa[_spread(gs, size[gs])]
        own = group[member]
        at = member - 1
        open_ = np.flatnonzero(at >= floor[member])
        while len(open_):  # previous suffix outside the higher groups
            j = at[open_]
            up = group[j] > own[open_]
            open_, j = open_[up], j[up]
            at[open_] = prev[j]
            open_ = open_[at[open_] >= floor[member[open_]]]
        at[at < floor[member]] = -1
        prev[member] = at
        while True:  # and outside the own group
            same = np.flatnonzero(at >= 0)
            same = same[group[at[same]] == own[same]]
            if len(same) == 0:
                break
            at[same] = prev[at[same]]
            prev[member] = at
        found, count = np.unique(at[at >= 0], return_counts=True)
        if len(found):
            old = group[found]
            order = np.lexsort((found, count, old))
            found, count, old = found[order], count[order], old[order]
            first = np.ones(len(old), dtype=bool)
            first[1:] = old[1:] != old[:-1]
            at_first = np.flatnonzero(first)
            taken = np.diff(np.append(at_first, len(old)))
            groups = old[at_first]
            remain = size[groups] - taken
            slots = _spread(groups + remain, taken)  # the tail of each group
            limit = np.repeat(groups + remain, taken)
            moving[found] = True
            there = sa[slots]
            stay = there[~moving[there]]  # give way to the front
            hole = place[found]
            vacant = hole[hole < limit]
            sa[vacant] = stay
            place[stay] = vacant
            sa[slots] = found
            place[found] = slots
            moving[found] = False
            new = first.copy()
            new[1:] |= count[1:] != count[:-1]
            at_new = np.flatnonzero(new)
            start = slots[at_new]
            size[groups] = remain
            size[start] = np.diff(np.append(at_new, len(old)))
            group[found] = start[np.cumsum(new) - 1]
        done = gs <= base[live]
        live, gs = live[~done], gs[~done]
        cursor[live] = group[sa[gs - 1]]

    # phase 2: from the lowest place of every string upwards
    free = np.zeros(n, np.int64)
    heads = np.unique(group)
    free[heads] = heads
    out = np.full(n, -1, np.int64)
    placed = np.zeros(n, dtype=bool)
    last = bounds[1:] - 1
    out[base] = last
    placed[last] = True
    free[base] += 1
    for step in range(int(lengths.max()) if len(lengths) else 0):
        on = lengths > step
        j = out[base[on] + step] - 1
        low = base[on]
        while len(j):
            ok = j >= low
            j, low = j[ok], low[ok]
            ok = ~placed[j]
            j, low = j[ok], low[ok]
            if len(j) == 0:
                break
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = prev[j]
    return out
