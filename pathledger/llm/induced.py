"""Suffix and LCP arrays by induced sorting with disk-backed priority queues.

Suffixes are L (larger than their successor) or S. The S suffixes after an L ("stars") are sorted first, through the
reduced string of their substrings' names, recursively; a scan up induces the L suffixes and a scan down the S
suffixes. Tuples (character, position, common prefix with the tuple before) wait in a priority queue keyed by
character; whatever exceeds the queue's memory lies in an anonymous temporary file, which the system removes with the
process. A bucket of one character is popped and processed at once, in rounds for runs of that character.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Tuples of all queues of a sort that stay in memory.
QUEUE_TUPLES = 1 << 22
#: Reduced strings over more names than this are finished by doubling of ranks.
MOST_BUCKETS = 4096


class DiskQueue:
    """Tuples by character, first in first out within a character; appended batches spill as sorted runs."""

    def __init__(self, symbols: int, memory: int = QUEUE_TUPLES):
        self.memory, self.held, self.file = memory, 0, None
        self.live: list[list[np.ndarray]] = [[] for _ in range(symbols)]
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(symbols)]

    def push(self, symbol: np.ndarray, rows: np.ndarray) -> None:
        """rows: (n, 2) positions and common prefixes, in order."""
        if not len(symbol):
            return
        order = np.argsort(symbol, kind="stable")
        symbol, rows = symbol[order], rows[order]
        heads = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        for a, b in zip(heads, np.append(heads[1:], len(symbol))):
            self.live[symbol[a]].append(rows[a:b])
        self.held += len(symbol)
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for c, parts in enumerate(self.live):
            if parts:
                data = np.concatenate(parts)
                self.runs[c].append((self.file.tell(), len(data)))
                self.file.write(np.ascontiguousarray(data).tobytes())
                self.live[c] = []
        self.held = 0

    def pop(self, c: int) -> np.ndarray:
        parts = []
        for at, n in self.runs[c]:
            self.file.seek(at)
            parts.append(np.frombuffer(self.file.read(n * 16), np.int64).reshape(-1, 2))
        parts += self.live[c]
        self.held -= sum(map(len, self.live[c]))
        self.runs[c], self.live[c] = [], []
        return np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)


class RangeMin:
    """Minimum of any range, from a table of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels, step = [values], 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima of [lo, hi)."""
        size = hi - lo
        level = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
        out = np.zeros(len(lo), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            t = self.levels[k]
            out[at] = np.minimum(t[lo[at]], t[hi[at] - (1 << int(k))])
        return out


def run_lengths(t: np.ndarray) -> np.ndarray:
    """Length of the run of equal symbols that starts at each position."""
    n = len(t)
    last = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)
    return last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1


def types(t: np.ndarray) -> np.ndarray:
    """True for S. The last suffix is S by convention of a sentinel below everything (it ends the text)."""
    n = len(t)
    ends = np.arange(n) + run_lengths(t) - 1
    out = np.zeros(n, bool)
    inner = ends < n - 1
    out[inner] = t[ends[inner] + 1] > t[ends[inner]]
    return out


def _next(queue: DiskQueue, t: np.ndarray, pos: np.ndarray, lcp: np.ndarray, take: np.ndarray) -> None:
    """Push the predecessors of the sources `take` (indices into pos): common prefixes are 1 + the least between sources."""
    if not len(take):
        return
    pred = pos[take] - 1
    sym = t[pred]
    order = np.argsort(sym, kind="stable")
    sym, src = sym[order], take[order]
    first = np.concatenate([[True], sym[1:] != sym[:-1]])
    prev = np.concatenate([[0], src[:-1]])
    value = np.zeros(len(src), np.int64)
    mid = np.flatnonzero(~first)
    if len(mid):
        value[mid] = 1 + RangeMin(lcp)(prev[mid] + 1, src[mid] + 1)
    heads = np.flatnonzero(first)
    value[heads] = 1  # the source before lies in another bucket, or there is none
    queue.push(sym, np.stack([pos[src] - 1, value], axis=1))


def induce(t: np.ndarray, is_s: np.ndarray, star: np.ndarray, star_lcp: np.ndarray, symbols: int, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of all suffixes, common prefix with the one before), given the stars in order with theirs.

    The last suffix is an L suffix whose successor is the empty one.
    """
    n = len(t)
    runs = run_lengths(t)
    at = np.searchsorted(t[star], np.arange(symbols + 1)) if len(star) else np.zeros(symbols + 1, np.int64)
    queue = DiskQueue(symbols, memory)
    queue.push(t[n - 1 : n], np.array([[n - 1, 0]]))
    l_parts: list[tuple[np.ndarray, np.ndarray]] = []
    for c in range(symbols):
        rows = queue.pop(c)
        pos_parts, lcp_parts = [], []
        cur, cur_lcp = rows[:, 0], rows[:, 1]
        while len(cur):
            pos_parts.append(cur)
            lcp_parts.append(cur_lcp)
            same = np.flatnonzero((cur > 0) & (t[np.maximum(cur - 1, 0)] == c))
            nxt = cur[same] - 1
            if len(same) > 1:
                inner = 1 + RangeMin(cur_lcp)(same[:-1] + 1, same[1:] + 1)
                lcp_next = np.concatenate([[0], inner])
            else:
                lcp_next = np.zeros(len(same), np.int64)
            if len(nxt):  # against the round before: the shorter run ends first
                lcp_next[0] = min(runs[nxt[0]], runs[cur[-1]])
            cur, cur_lcp = nxt, lcp_next
        pos = np.concatenate(pos_parts) if pos_parts else np.zeros(0, np.int64)
        lcp = np.concatenate(lcp_parts) if lcp_parts else np.zeros(0, np.int64)
        if len(lcp):
            lcp[0] = 0
        l_parts.append((pos, lcp))
        stars = star[at[c] : at[c + 1]]
        both = np.concatenate([pos, stars])
        both_lcp = np.concatenate([lcp, star_lcp[at[c] : at[c + 1]]])
        if len(pos) and len(stars):
            both_lcp[len(pos)] = min(runs[pos[-1]], runs[stars[0]])
        take = np.flatnonzero((both > 0) & (t[np.maximum(both - 1, 0)] > c))
        _next(queue, t, both, both_lcp, take)
    queue = DiskQueue(symbols, memory)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for c in range(symbols - 1, -1, -1):  # descending: everything is reversed
        rows = queue.pop(c)
        pos_parts, lcp_parts = [], []
        cur, cur_lcp = rows[:, 0], rows[:, 1]
        while len(cur):
            pos_parts.append(cur)
            lcp_parts.append(cur_lcp)
            same = np.flatnonzero((cur > 0) & (t[np.maximum(cur - 1, 0)] == c))
            nxt = cur[same] - 1
            if len(same) > 1:
                lcp_next = np.concatenate([[0], 1 + RangeMin(cur_lcp)(same[:-1] + 1, same[1:] + 1)])
            else:
                lcp_next = np.zeros(len(same), np.int64)
            if len(nxt):
                lcp_next[0] = min(runs[nxt[0]], runs[cur[-1]])
            cur, cur_lcp = nxt, lcp_next
        s_pos = np.concatenate(pos_parts) if pos_parts else np.zeros(0, np.int64)
        s_lcp = np.concatenate(lcp_parts) if lcp_parts else np.zeros(0, np.int64)
        l_pos, l_lcp = l_parts[c]
        pos = np.concatenate([s_pos, l_pos[::-1]])
        lcp = np.concatenate([s_lcp, np.append(0, l_lcp[:0:-1]) if len(l_pos) else l_lcp])
        if len(s_pos) and len(l_pos):
            lcp[len(s_pos)] = min(runs[s_pos[-1]], runs[l_pos[-1]])
        if len(lcp):
            lcp[0] = 0
        out.append((pos, lcp))
        take = np.flatnonzero((pos > 0) & (t[np.maximum(pos - 1, 0)] < c))
        _next(queue, t, pos, lcp, take)
    order = np.concatenate([p for p, _ in out])[::-1]
    down = np.concatenate([x for _, x in out])
    return order, np.append(0, down[:0:-1]) if len(down) else down


def by_doubling(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The base case: ranks of prefixes of 1, 2, 4, ... symbols; common prefixes by descent through the ranks."""
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64) + 1
    levels, step = [rank], 1
    while rank.max(initial=0) < n:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] if step < n else after[:-step]
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        levels.append(rank)
        step *= 2
    order = np.argsort(rank)
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    got = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = (a < n) & (b < n)
        ok[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        ok &= np.maximum(a, b) + (1 << k) <= n  # whole prefixes
        got[ok] += 1 << k
        a[ok] += 1 << k
        b[ok] += 1 << k
    lcp[1:] = got
    return order, lcp


def suffix_array(t: np.ndarray, symbols: int | None = None, memory: int = QUEUE_TUPLES) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, common prefix of each suffix with the one before) of symbols 0 .. symbols - 1."""
    t = np.asarray(t).astype(np.int64)
    n = len(t)
    if n <= 1:
        return np.arange(n), np.zeros(n, np.int64)
    symbols = symbols or int(t.max()) + 1
    if symbols > MOST_BUCKETS:
        return by_doubling(t)
    is_s = types(t)
    star = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if not len(star):
        return induce(t, is_s, star, np.zeros(0, np.int64), symbols, memory)
    # substrings of stars, sorted by inducing from stars in the order of their first symbols alone
    rough = star[np.argsort(t[star], kind="stable")]
    order, _ = induce(t, is_s, rough, np.zeros(len(rough), np.int64), symbols, memory)
    mark = np.zeros(n, bool)
    mark[star] = True
    stars = order[mark[order]]
    stop = np.append(star[1:] + 1, n)  # a substring ends with the next star's first symbol, the last one with the text
    size = np.zeros(n, np.int64)
    size[star] = stop - star
    common = np.zeros(len(stars), np.int64)
    live = np.arange(1, len(stars))
    while len(live):
        a, b = stars[live - 1], stars[live]
        k = common[live]
        go = (k < size[a]) & (k < size[b])
        go[go] = t[(a + k)[go]] == t[(b + k)[go]]
        live = live[go]
        common[live] += 1
    prev, now = stars[:-1], stars[1:]
    equal = (common[1:] == size[prev]) & (size[prev] == size[now]) & (now != star[-1]) & (prev != star[-1])
    name = np.concatenate([[0], np.cumsum(~equal)])
    length = run_lengths(t)

    def beyond(a: np.ndarray, b: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Unequal substrings of which one ends as a part of the other share the shorter run at that end."""
        out, end = k.copy(), np.flatnonzero((k > 0) & (k >= np.minimum(size[a], size[b])))
        x, y = a[end] + k[end] - 1, b[end] + k[end] - 1
        out[end] = k[end] - 1 + np.minimum(length[x], length[y])
        return out

    names = np.zeros(n, np.int64)
    names[stars] = name
    reduced = names[star]
    if name[-1] + 1 == len(star):
        sorted_star, star_lcp = stars, np.append(0, beyond(prev, now, common[1:]))
    else:
        sub, sub_lcp = suffix_array(reduced, int(name[-1]) + 1, memory)
        sorted_star = star[sub]
        first_of = np.flatnonzero(np.concatenate([[True], ~equal]))
        between = RangeMin(common)
        star_lcp = np.zeros(len(star), np.int64)
        i, j, m = sub[:-1], sub[1:], sub_lcp[1:]
        inside = star[np.minimum(i + m, len(star) - 1)] - star[i]  # whole substrings overlap in one symbol
        x, y = np.minimum(i + m, len(star) - 1), np.minimum(j + m, len(star) - 1)
        lo, hi = np.minimum(reduced[x], reduced[y]), np.maximum(reduced[x], reduced[y])
        diff = np.zeros(len(m), np.int64)
        ne = np.flatnonzero((lo < hi) & (i + m < len(star)) & (j + m < len(star)))
        diff[ne] = beyond(star[x[ne]], star[y[ne]], between(first_of[lo[ne]] + 1, first_of[hi[ne]] + 1))
        star_lcp[1:] = inside + diff
    return induce(t, is_s, sorted_star, star_lcp, symbols, memory)
