"""T-occurrence search over inverted lists by DivideSkip, inside one block of token sets."""

from __future__ import annotations

import math

import numpy as np

#: Weight of a step of the merge against a binary probe; sets how many lists count as long.
MU = 0.0085
#: Steps of the merge that take as long as one probe, and as a list's probes take beside that.
PROBE, LIST = 30, 3000


def links(common, a, b, percent: int):
    """Whether sets of a and b tokens link that have so many in common; numbers or arrays."""
    return 100 * common >= percent * (a + b - common)


def occurrences(lists: list[np.ndarray], needed: int) -> tuple[np.ndarray, np.ndarray]:
    """(records, occurrences) of the records, small numbers, that are in at least `needed` of the sorted lists.

    The longest lists are set aside; the short ones are merged by counting; what they hold often enough is probed in
    the long ones by binary search, from the shortest on.  Where that takes longer than to merge them, they are merged.
    """
    lists = sorted(lists, key=len, reverse=True)
    longest = len(lists[0]) if lists else 0
    aside = min(int(needed / (MU * math.log2(longest + 1) + 1)), needed - 1) if needed > 1 else 0
    long, short = lists[:aside][::-1], lists[aside:]
    counts = np.bincount(np.concatenate(short)) if short else np.zeros(0, np.int64)
    records = np.flatnonzero(counts >= max(1, needed - len(long)))
    if len(records) and len(long) * (PROBE * len(records) + LIST) > sum(map(len, long)):
        counts = np.bincount(np.concatenate([*long, *short]))
        records, long = np.flatnonzero(counts >= needed), []
    counts = counts[records]
    for left, x in zip(range(len(long) - 1, -1, -1), long, strict=True):
        at = np.minimum(np.searchsorted(x, records), len(x) - 1)
        counts += x[at] == records
        stay = counts >= needed - left
        records, counts = records[stay], counts[stay]
        if not len(records):
            break
    return records, counts


def divide_skip(lists: list[np.ndarray], needed: int) -> list[tuple[int, int]]:
    """`occurrences` as pairs."""
    return list(zip(*(x.tolist() for x in occurrences(lists, needed)), strict=True))


def block_links(sets: list[np.ndarray], percent: int, asks: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links between sets (sorted, distinct tokens) that span the components of the links sought.

    Without `asks`, of all links in the block: set 0 is the hub, whose overlap with every other set is counted first;
    sets that it links to need no search against one another, every other set searches the whole block.  With
    `asks`, of the links that the sets marked in it have with any set of the block.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    part, out = np.arange(n), []  # part: a name of each set's component so far

    if asks is None:
        hub = sets[0]
        at = np.minimum(np.searchsorted(hub, tokens), len(hub) - 1)
        common = np.bincount(owner[hub[at] == tokens], minlength=n)
        near = 100 * common >= percent * (sizes[0] + sizes - common)
        out += [(0, i) for i in np.flatnonzero(near).tolist() if i]
        part[near] = part[0]
        rest = np.flatnonzero(~near)
    else:
        rest = np.flatnonzero(asks)
    if not len(rest):
        return out

    order = np.argsort(tokens, kind="stable")
    ranked, holders = tokens[order], owner[order]
    heads = np.r_[True, ranked[1:] != ranked[:-1]]
    begins = np.flatnonzero(heads)
    ends = np.r_[begins[1:], len(ranked)]
    lists = np.empty(len(tokens), np.int64)  # the number of each token's list
    lists[order] = np.cumsum(heads) - 1
    shared = (ends - begins > 1)[lists]  # lists that hold another record too
    first = np.r_[0, np.cumsum(sizes)]
    held, least = np.bincount(owner[shared], minlength=n), -(-percent * sizes // 100)
    for i in rest[held[rest] >= least[rest]].tolist():
        mine = lists[first[i] : first[i + 1]][shared[first[i] : first[i + 1]]]
        found, common = occurrences([holders[a:b] for a, b in zip(begins[mine].tolist(), ends[mine].tolist(), strict=True)], int(least[i]))
        near = links(common, sizes[i], sizes[found], percent)
        for j in found[near & (part[found] != part[i])].tolist():
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
                out.append((min(i, j), max(i, j)))
    return out
