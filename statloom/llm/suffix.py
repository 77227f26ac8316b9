"""Suffix arrays by induced sorting, and permuted common prefixes, as numpy passes.

The text is a byte array of strings that each end with ``END`` (0); other bytes are 1 or more and below ``PAD``. The
ends count as different symbols, in the order of their place, so no comparison runs from one string into the next.
"""

from __future__ import annotations

import numpy as np

END, PAD = 0, 0xFF


def types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one that follows it (the last counts as smaller)."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int16))).astype(np.int8)
    places = np.where(step != 0, np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(places[::-1])[::-1]  # the next place where the byte changes
    small = np.ones(n, dtype=bool)
    small[: n - 1] = np.append(step, np.int8(1))[following] > 0
    return small


def leftmost(small: np.ndarray) -> np.ndarray:
    """Places of the leftmost smaller suffixes."""
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _names(t: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Dense ranks of the substrings from each leftmost place to the next, both included. A substring that begins
    another ranks after it (its end is a smaller-type byte), which the filling byte does."""
    size = np.diff(np.append(lms, lms[-1])) + 1
    padded = np.concatenate([t, np.full(8, PAD, np.uint8)])
    rank = np.zeros(len(lms), dtype=np.int64)
    todo = np.arange(len(lms))
    at = 0
    while len(todo):
        place = lms[todo, None] + at + np.arange(8)
        inside = (at + np.arange(8)) < size[todo, None]
        word = np.where(inside, padded[np.minimum(place, len(padded) - 1)], PAD).astype(np.uint8).view(">u8")[:, 0].astype(np.uint64)
        order = np.lexsort((word, rank[todo]))
        r, w = rank[todo][order], word[order]
        new_rank = np.concatenate([[True], r[1:] != r[:-1]])
        new = new_rank | np.concatenate([[True], w[1:] != w[:-1]])
        # The rank of a group is the number of members of all groups before it; inside, it moves on by position.
        first = np.maximum.accumulate(np.where(new_rank, np.arange(len(order)), 0))
        group = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        rank[todo[order]] = r + (group - first)
        at += 8
        longer = np.unique(rank[todo[size[todo] > at]])
        todo = todo[np.isin(rank[todo], longer)] if len(longer) else todo[:0]
    return rank


def order_leftmost(t: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The leftmost places in the order of their suffixes: named substrings, then names of pairs of names, of pairs of
    those, and so on. Only names that are not yet unique are named again; each end is a name of its own."""
    ends = t[lms] == END
    rank = _names(t, lms)
    rank[ends] = np.arange(int(ends.sum()))
    span = 1
    order = np.argsort(rank, kind="stable")
    while True:
        r = rank[order]
        twin = np.zeros(len(r), dtype=bool)
        twin[1:] = r[1:] == r[:-1]
        twin[:-1] |= twin[1:]
        todo = np.sort(order[twin])
        if not len(todo):
            return lms[order]
        after = rank[np.minimum(todo + span, len(rank) - 1)]
        inner = np.lexsort((after, rank[todo]))
        r, a = rank[todo][inner], after[inner]
        new_rank = np.concatenate([[True], r[1:] != r[:-1]])
        new = new_rank | np.concatenate([[True], a[1:] != a[:-1]])
        first = np.maximum.accumulate(np.where(new_rank, np.arange(len(inner)), 0))
        group = np.maximum.accumulate(np.where(new, np.arange(len(inner)), 0))
        rank[todo[inner]] = r + (group - first)
        order = np.argsort(rank, kind="stable")
        span *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order. From the ordered leftmost places the larger suffixes are induced byte by byte
    upwards, from these the smaller ones downwards; each place is moved once in each direction."""
    small = types(t)
    lms = leftmost(small)
    if not len(lms) or lms[-1] != len(t) - 1:
        lms = np.append(lms, len(t) - 1)  # a single string of one byte
    lms = order_leftmost(t, lms).astype(np.int32)
    heads = t[lms]
    seeds = {c: lms[a:b] for c, a, b in _parts(heads)}
    up: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger: list[np.ndarray] = []
    none = np.empty(0, np.int32)

    def push(found: np.ndarray, into: list[list[np.ndarray]]) -> None:
        byte = t[found]
        order = np.argsort(byte, kind="stable")
        for c, a, b in _parts(byte[order]):
            into[c].append(found[order[a:b]])

    for c in range(256):
        own = up[c]
        frontier = np.concatenate(own) if own else none
        whole = [frontier]
        while len(frontier):
            found = _before(frontier)
            found = found[~small[found]]
            same = t[found] == c
            push(found[~same], up)
            frontier = found[same]
            whole.append(frontier)
        larger.append(np.concatenate(whole))
        if c in seeds:
            found = _before(seeds[c])
            push(found[~small[found]], up)
    down: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []
    for c in range(255, 0, -1):
        own = down[c]
        frontier = np.concatenate(own) if own else none
        whole = [frontier]
        while len(frontier):
            found = _before(frontier)
            found = found[small[found]]
            same = t[found] == c
            push(found[~same], down)
            frontier = found[same]
            whole.append(frontier)
        found = _before(larger[c][::-1])
        push(found[small[found]], down)
        out.append(np.concatenate(whole))
        out.append(larger[c][::-1])
    out.append(np.flatnonzero(t == END).astype(np.int32)[::-1])
    return np.concatenate(out)[::-1]


def _before(places: np.ndarray) -> np.ndarray:
    return places[places > 0] - 1


def _parts(sorted_bytes: np.ndarray):
    if len(sorted_bytes):
        cuts = np.flatnonzero(np.diff(sorted_bytes)) + 1
        begins = np.concatenate([[0], cuts])
        yield from zip(sorted_bytes[begins].tolist(), begins.tolist(), [*cuts.tolist(), len(sorted_bytes)])


def common_prefixes(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place the length it has in common with the suffix before it in the order, within its string. Only
    where the bytes before both differ are they compared; elsewhere it is one less than at the place before."""
    n = len(t)
    prior = np.full(n, -1, dtype=np.int64)
    prior[order[1:]] = order[:-1]
    ends = np.flatnonzero(t == END)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (prior[1:] <= 0) | (t[:-1] != t[np.maximum(prior[1:], 1) - 1]) | (t[:-1] == END)
    at = np.flatnonzero(fresh)
    length = np.zeros(len(at), dtype=np.int64)
    padded = np.concatenate([t, np.zeros(16, np.uint8)])
    words = np.ndarray((n + 8,), dtype="<u8", buffer=padded, strides=(1,))
    live = np.flatnonzero(prior[at] >= 0)
    while len(live):
        i = at[live] + length[live]
        j = prior[at[live]] + length[live]
        inside = (i < n) & (j < n)
        differ = np.where(inside, words[np.minimum(i, n)] ^ words[np.minimum(j, n)], np.uint64(1))
        same = np.zeros(len(live), dtype=np.int64)
        for k in range(1, 9):
            same += (differ & np.uint64((1 << (8 * k)) - 1)) == 0
        length[live] += same
        live = live[(same == 8) & (length[live] < left[at[live]])]
    value = np.minimum(length, left[at])
    owner = np.searchsorted(at, np.arange(n), side="right") - 1
    return np.minimum(np.maximum(value[owner] - (np.arange(n) - at[owner]), 0), left)
