"""Which long blocks of one page its other blocks restate, by counts of shared shingles.

Runs inside Arrow batches (operators/assemble.py); nothing here touches Spark. Memory is in proportion to a page's words.
"""

from __future__ import annotations

import re

import numpy as np

#: White space as Java's \\s has it, so that words are those of split() on columns.
SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair (a, b), equal for equal pairs only."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int64)


def six_word_runs(words: np.ndarray) -> np.ndarray:
    """A number for each run of six words, equal for equal runs only, by doubling: two words, four, six."""
    two = ranks(words[:-1], words[1:])
    four = ranks(two[:-2], two[2:])
    return ranks(four[:-2], two[4:])


def restated(blocks: list[tuple[int, str]], least: int, share: float, single: float) -> list[int]:
    """Positions of blocks (pos, lower-case text) of `least` words or more whose distinct 6-word shingles other positions
    hold to `share`, and no single one to `single`."""
    known: dict[str, int] = {}
    parts, sizes = [], []
    for _, text in blocks:
        words = [known.setdefault(w, len(known)) for w in SPACE.split(text) if w]
        parts.append(np.array(words, np.int64))
        sizes.append(len(words))
    n = np.array(sizes)
    if not (n >= least).any() or n.sum() < 6:
        return []
    runs, row = six_word_runs(np.concatenate(parts)), np.repeat(np.arange(len(blocks)), n)
    inside = row[:-5] == row[5:]
    held = np.unique(np.stack([row[:-5][inside], runs[inside]]), axis=1)  # a shingle counts once a block
    row, run = held
    first = np.searchsorted(row, np.arange(len(blocks) + 1))
    by_run = np.argsort(run, kind="stable")
    holders, edge = row[by_run], np.searchsorted(run[by_run], np.arange(int(run.max(initial=-1)) + 2))
    pos = np.array([p for p, _ in blocks])
    places, at = np.unique(pos, return_inverse=True)
    found = []
    for place in np.unique(at[n >= least]):
        own = np.concatenate([run[first[r] : first[r + 1]] for r in np.nonzero((at == place) & (n >= least))[0]])
        often = own[edge[own + 1] - edge[own] > 1]
        if not len(often) or len(often) < share * len(own):
            continue
        some = holders[edge[often[len(often) // 2]] : edge[often[len(often) // 2] + 1]]
        some = some[at[some] != place][:1]  # one likely copy spares the count of all others
        if len(some) and np.isin(own, run[first[some[0]] : first[some[0] + 1]]).sum() >= single * len(own):
            continue
        many = edge[often + 1] - edge[often]
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        other = at[holders[np.repeat(edge[often], many) + within]]
        away = other != place
        covered = len(np.unique(np.repeat(often, many)[away]))
        if covered and covered >= share * len(own) and np.bincount(other[away]).max() < single * len(own):
            found.append(int(places[place]))
    return found
