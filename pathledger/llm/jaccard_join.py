"""Exact Jaccard join of shingle sets as a metric-space join.

A set of n shingles links with another only if at least `percent` of its own shingles occur in other sets. One pass of
short keys counts those, with errors only upwards, and leaves the few sets that can have a link (the candidates).
Pivots are chosen among them, one for every part of a set that two candidates share: the least holder. Each candidate
lies in the cells of the pivots that it shares a part with, and linked sets always share one. In a cell exact distances
to the pivot settle what lies within reach of it; triangle-inequality windows leave of the others what may still
link, and that is joined recursively around further pivots. Cells beyond a stated size recurse as DataFrames, over
Voronoi regions of several pivots, in chunks that any number of tasks share.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathledger.llm import textcore as tc
from pathledger.llm.common import components, cut_lineage, frees_shuffles, partitions

SALTS = 8
LEAF = 48
PIVOTS = 16
#: Elements of a cell that one task may hold, and of a larger cell's chunk. A cell may always hold LEAF sets.
CELL_SHINGLES = 2_000_000
BUCKET_BYTES = 24 << 20
MESSAGE_KEYS = 1_000_000
#: What a task works on at once, of however many rows a batch has: elements, distances to a block's sets, and postings of a block.
SLICE = 500_000
#: Candidates (8 bytes each) that may be broadcast to fetch their texts; beyond, both sides are shuffled.
BROADCAST_IDS = 500_000


def classes(most: int = 1 << 40, ratio: float = 1.5) -> list[int]:
    """Lower bounds of size classes."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * ratio))))
    return out


BOUNDS = np.array(classes(), dtype=np.int64)


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes sorted within each document, bounds of the documents)."""
    h, doc, _, _ = tc.words(data, offs)
    docs = len(offs) - 1
    g, gd = tc.grams(h, doc, n)
    count = np.bincount(doc, minlength=docs)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        begin = np.searchsorted(doc, short)
        whole = np.array([tc.mix(np.array([np.uint64(c) + np.sum(h[b : b + c] * tc.GRAM[32 : 32 + c], dtype=np.uint64)]))[0] for b, c in zip(begin, count[short])], np.uint64)
        g, gd = np.concatenate([g, whole]), np.concatenate([gd, short])
    order = np.lexsort((g, gd))
    g, gd = g[order], gd[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (gd[1:] != gd[:-1])
    g, gd = g[keep], gd[keep]
    return g, np.searchsorted(gd, np.arange(docs + 1))


def spare_parts(parts: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Parts to add so that a class's smallest sets (`least` elements) seldom leave more than those empty.

    Depends on the class alone, since linked sets must be dealt into equally many parts. Where sets are too small
    for that, further salts have to do.
    """
    some = 2 + parts // 100
    spare = some
    for _ in range(30):
        empty = (parts + spare) * np.exp(-least / (parts + spare))
        spare = np.minimum(np.maximum(some, np.ceil(empty + 3 * np.sqrt(empty)).astype(np.int64)), parts + 2)
    return np.where(spare <= parts, spare, some)


def part_keys(sets: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, key): linked documents share a key.

    In a class with sizes up to u, sets with |A & B| * 100 >= percent * |A | B| differ in at most k elements,
    k = floor(q * 2u / (200 - q)) with q = 100 - percent. With k + 1 + e parts, at least e + 1 parts are equal, and
    one of them has elements if either set has at most e empty parts. A set with more is dealt again with the next
    salt; with the last salt empty parts are keys too. So nothing is missed whatever the hash does.
    """
    q = 100 - percent
    n = np.diff(bounds)
    own = np.searchsorted(BOUNDS, n, "right") - 1
    out_doc, out_key = [], []
    up, todo = 0, np.flatnonzero(n > 0)
    while len(todo):  # a set is dealt into its own class and into each further one that a linked set may have
        cls = own + up
        for salt in range(SALTS):
            if not len(todo):
                break
            most = BOUNDS[cls[todo] + 1] - 1
            k = q * 2 * most // (200 - q)
            todo, k = todo[k > 0], k[k > 0]  # no room for a difference: equal sets alone, and those are one class
            if not len(todo):
                break
            m0 = k + 1
            spare = spare_parts(m0, BOUNDS[cls[todo]] * percent / 100)
            m = m0 + spare
            size = n[todo]
            take = np.repeat(bounds[todo], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            el = sets[take]
            dealt = tc.mix(el ^ tc.U(0xA5A5A5A5 + salt * 7919))
            local = np.repeat(np.arange(len(todo)), size)
            base = np.concatenate([[0], np.cumsum(m)])
            flat = base[local] + ((dealt >> tc.U(20)).astype(np.int64) % m[local])
            order = np.argsort(flat, kind="stable")
            edge = np.searchsorted(flat[order], np.arange(base[-1] + 1))
            total = tc.order_free(el[order], edge)
            filled = np.diff(edge) > 0
            owner = np.repeat(np.arange(len(todo)), m)
            j = (np.arange(base[-1]) - base[owner]).astype(np.uint64)
            key = tc.mix(total + j * tc.GRAM[40] + cls[todo][owner].astype(np.uint64) * tc.GRAM[41] + np.uint64(salt * 0x9E3779B97F4A7C1 & (2**64 - 1)))
            last = salt == SALTS - 1
            use = np.ones(len(key), bool) if last else filled
            out_doc.append(todo[owner[use]])
            out_key.append(key[use])
            empty = m - np.bincount(owner[filled], minlength=len(todo))
            todo = todo[empty > spare]
        up += 1
        todo = np.flatnonzero((n > 0) & (n * 100 >= percent * BOUNDS[own + up]))
    if not out_doc:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_doc), np.concatenate(out_key)


class Sets:
    """Sorted sets of a cell with union-find; joins them by pivots, windows and recursion."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], percent: int):
        self.ids, self.sets, self.percent = ids, sets, percent
        self.theta = (100 - percent) / 100 + 1e-9
        self.root = list(range(len(ids)))
        self.size = np.array([len(s) for s in sets])

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def union(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)

    def linked(self, i: int, j: int) -> bool:
        a, b = self.size[i], self.size[j]
        if min(a, b) * 100 < self.percent * max(a, b):
            return False
        both = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
        return both * 100 >= self.percent * (a + b - both)

    def shared(self, members: np.ndarray, pivot: int) -> np.ndarray:
        """|member & pivot| for each member, in one pass over their elements."""
        p = self.sets[pivot]
        cat = np.concatenate([self.sets[i] for i in members])
        at = np.minimum(np.searchsorted(p, cat), len(p) - 1)
        ends = np.cumsum(self.size[members])
        total = np.concatenate([[0], np.cumsum(p[at] == cat)])
        return total[ends] - total[ends - self.size[members]]

    def leaf(self, members: np.ndarray) -> None:
        """Exact join of a large cell that windows can't divide: links share one of their rarest elements (prefix filter).

        Only holders outside an element's most frequent component are compared, all at once with each member: what
        is linked already costs no comparison, however many copies share the element.
        """
        cat = np.concatenate([self.sets[i] for i in members])
        own = np.repeat(np.arange(len(members)), self.size[members])
        _, inverse, counts = np.unique(cat, return_inverse=True, return_counts=True)
        order = np.lexsort((inverse, counts[inverse], own))
        n = self.size[members]
        rank = np.arange(len(cat)) - np.repeat(np.cumsum(n) - n, n)
        need = -(-n * self.percent // 100)
        first = order[rank < np.repeat(n - need + 1, n)]
        first = first[counts[inverse[first]] > 1]
        if not len(first):
            return
        order = np.lexsort((own[first], inverse[first]))
        element, holder = inverse[first][order], own[first][order]
        root = np.array([self.find(int(i)) for i in members])
        start = np.flatnonzero(np.diff(element, prepend=-1))
        stop = np.append(start[1:], len(element))
        mixed = np.minimum.reduceat(root[holder], start) != np.maximum.reduceat(root[holder], start)
        apart = np.zeros(len(members), bool)
        for s, e in zip(start[mixed], stop[mixed]):
            group = holder[s:e]
            names, times = np.unique(root[group], return_counts=True)
            apart[group[root[group] != names[times.argmax()]]] = True
        if not apart.any():
            return
        some = np.flatnonzero(apart)
        block = Block(members[some].tolist(), root[some].tolist(), [self.sets[i] for i in members[some]])
        bounds = np.concatenate([[0], np.cumsum(n)])
        for lo, hi in _slices(bounds, SLICE, max(1, SLICE // len(some))):
            both = block.shared(cat[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
            hit = both * 100 >= self.percent * (n[lo:hi, None] + block.size[None, :] - both)
            for x, y in block.join(hit, members[lo:hi].tolist(), root[lo:hi].tolist()):
                self.union(x, y)

    def around(self, members: np.ndarray, pivot: int) -> np.ndarray:
        """Link what lies within reach of the pivot; return the members that may still have another link.

        y links with x only if their distances to the pivot differ by theta at most (triangle inequality), and only
        members of unlike components are worth a comparison.
        """
        both = self.shared(members, pivot)
        whole = self.size[members] + self.size[pivot] - both
        for i in members[both * 100 >= self.percent * whole]:
            self.union(int(i), int(pivot))
        far, dist = members != pivot, 1 - both / whole
        members, dist = members[far], dist[far]
        root = np.array([self.find(int(i)) for i in members], np.int64)
        rest = root != self.find(int(pivot))
        line = np.sort(dist[rest])
        if not len(line):
            return members[:0]
        at = np.searchsorted(line, dist)
        gap = np.minimum(np.abs(line[np.minimum(at, len(line) - 1)] - dist), np.abs(line[np.maximum(at - 1, 0)] - dist))
        return members[rest | (gap <= self.theta)]

    def join(self, members: np.ndarray, pivot: int | None = None) -> None:
        stack = [members if pivot is None else self.around(members, pivot)]
        while stack:
            cell = stack.pop()
            if len(cell) < 2:
                continue
            root, place = np.unique([self.find(int(i)) for i in cell], return_index=True)
            if len(root) == 1:
                continue
            if len(cell) <= LEAF:
                counts = [sum(self.find(int(i)) == r for i in cell) for r in root]
                stack.append(self.around(cell, int(cell[place[int(np.argmin(counts))]])))
                continue
            pivots = cell[np.linspace(0, len(cell) - 1, min(PIVOTS, int(len(cell) ** 0.5))).astype(int)]
            both = np.stack([self.shared(cell, int(p)) for p in pivots], axis=1)
            whole = self.size[cell][:, None] + self.size[pivots][None, :] - both
            for k, p in enumerate(pivots):
                for i in cell[both[:, k] * 100 >= self.percent * whole[:, k]]:
                    self.union(int(i), int(p))
            dist = 1 - both / whole
            subs = voronoi(dist, self.theta)
            if max(map(len, subs)) > 0.75 * len(cell):  # windows that hold nearly all: one join of the cell is less
                self.leaf(cell)
            else:
                stack.extend(cell[sub] for sub in subs)

    def edges(self) -> list[tuple[int, int]]:
        least: dict[int, int] = {}
        for i, x in enumerate(self.ids):
            r = self.find(i)
            least[r] = min(x, least.get(r, x))
        return [(x, least[self.find(i)]) for i, x in enumerate(self.ids)]


def voronoi(dist: np.ndarray, theta: float) -> list[np.ndarray]:
    """Members of each cell and its window. Points out of every pivot's reach form a cell of their own.

    A link of x in cell j reaches y only if d(y, j) <= d(x, j) + theta, at most the cell's radius plus theta.
    """
    near, least = dist.argmin(axis=1), dist.min(axis=1)
    far = least >= 1 - theta
    out = []
    for j in range(dist.shape[1]):
        mine = (near == j) & ~far
        if mine.any():
            radius = dist[mine, j].max()
            window = (dist[:, j] <= radius + theta) & (dist[:, j] <= least + 2 * theta)
            out.append(np.flatnonzero(mine | window))
    if far.any():
        out.append(np.flatnonzero(far | (least >= 1 - 2 * theta)))
    return out


SENT_NAMES = ["message", "bucket", "docs", "counts", "keys", "more"]
SENT = "message bigint, bucket int, docs binary, counts binary, keys binary, more binary"
SENT_KINDS = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
MADE = "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, c bigint"
FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 6, SENT_KINDS)], SENT_NAMES)


def _sets(make, buckets: int):
    """Messages of whole documents, whose sets `make` gives: one row (bucket null) says what they are, one per bucket has the short keys of their
    shingles, by document.

    Equal sets of a message go once. A shingle that several sets of a message hold is counted for them at once and
    sent a single time without owners (`more`), whatever share of all rows has it.
    """

    def message(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, known, count, h1, h2 = (np.concatenate(x) for x in zip(*(h[:5] for h in held)))
        key = tc.mix(np.concatenate([h[5] for h in held]))
        first = np.zeros(len(ids), bool)
        first[np.unique(np.stack([h1, h2, count.astype(np.uint64), known.astype(np.uint64)]), axis=1, return_index=True)[1]] = True
        doc = np.repeat(np.arange(len(ids)), count)
        use = (first & known)[doc]
        doc, key = doc[use], key[use]
        order = np.argsort(key, kind="stable")
        doc, key = doc[order], key[order]
        again = np.zeros(len(key), bool)
        again[1:] = key[1:] == key[:-1]
        several = again.copy()
        several[:-1] |= again[1:]
        local = np.bincount(doc[several], minlength=len(ids))
        table = np.stack([ids.view(np.uint64), known.astype(np.uint64), count.astype(np.uint64), h1, h2, local.astype(np.uint64)]).tobytes()
        own = int.from_bytes(hashlib.blake2b(table, digest_size=8).digest(), "little", signed=True)
        rows = [(own, None, table, None, None, None)]
        bucket = ((key >> tc.U(32)) * tc.U(buckets) >> tc.U(32)).astype(np.int64)  # ascends with the keys
        short, at = key.astype(np.uint32), np.searchsorted(bucket, np.arange(buckets + 1))
        for i in np.flatnonzero(np.diff(at)):
            mine = slice(at[i], at[i + 1])
            alone = ~several[mine]
            d, k = doc[mine][alone], short[mine][alone]
            who, counts = np.unique(d, return_counts=True)
            rows.append((own, int(i), who.astype(np.uint32).tobytes(), counts.astype(np.uint32).tobytes(), k[np.argsort(d, kind="stable")].tobytes(), short[mine][several[mine] & ~again[mine]].tobytes()))
        yield _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0)
            known, number = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for first, data, offs in tc.chunks(batch.column(1)):
                sets, bounds = make(data, offs)
                part = slice(first, first + len(offs) - 1)
                held.append((number[part], known[part], np.diff(bounds), tc.order_free(sets, bounds), tc.order_free(sets, bounds, 1), sets))
                size += len(sets) + len(offs)
                if size > MESSAGE_KEYS:
                    yield from message(held)
                    held, size = [], 0
        if held:
            yield from message(held)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass documents on; for each message count the keys of its documents that others have too in this bucket."""
    parts: list[tuple] = []
    for batch in batches:
        documents = batch.column(1).is_null()
        yield batch.filter(documents)
        parts += list(zip(*(batch.filter(batch.column(1).is_valid()).column(i).to_pylist() for i in range(6))))
    keys = [np.frombuffer(p[4], np.uint32) for p in parts]
    every = np.sort(np.concatenate([*keys, *(np.frombuffer(p[5], np.uint32) for p in parts)])) if parts else np.zeros(0, np.uint32)
    twice = every[1:][every[1:] == every[:-1]]
    if len(twice):
        rows = []
        for p, key in zip(parts, keys):
            hit = twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key
            doc = np.repeat(np.frombuffer(p[2], np.uint32), np.frombuffer(p[3], np.uint32))[hit]
            who, counts = np.unique(doc, return_counts=True)
            if len(who):
                rows.append((p[0], p[1], who.tobytes(), counts.astype(np.uint32).tobytes(), None, None))
        yield _rows(rows)


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A message's rows, its documents first -> doc_id, n_shingles, h1, h2, c: how many shingles others have too."""

    def done(tables: list[np.ndarray], more: np.ndarray) -> pa.RecordBatch:
        ids, known, count, h1, h2, local = np.concatenate(tables, axis=1)  # several: the same rows of the table once more
        c = local.astype(np.int64) + np.tile(more, len(tables))
        return pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64), mask=known == 0), *(pa.array(x.view(np.int64)) for x in (count, h1, h2)), pa.array(c)], ["doc_id", "n_shingles", "h1", "h2", "c"])

    now, tables, more = None, [], np.zeros(0, np.int64)
    for batch in batches:
        for own, bucket, docs, counts in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if own != now and tables:
                yield done(tables, more)
                tables = []
            now = own
            if bucket is None:
                tables.append(np.frombuffer(docs, np.uint64).reshape(6, -1))
                more = np.zeros(tables[-1].shape[1], np.int64)
            else:
                more[np.frombuffer(docs, np.uint32)] += np.frombuffer(counts, np.uint32)
    if tables:
        yield done(tables, more)


def _elements(make):
    """(doc_id, text) -> doc_id, a set hash, el: the sorted set. Texts without any give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offs in tc.chunks(batch.column(1)):
                sets, bounds = make(data, offs)
                out = [batch.column(0).slice(first, len(offs) - 1), pa.array(tc.signed(tc.order_free(sets, bounds))), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(tc.signed(sets)))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "h1", "el"]).filter(pa.array(np.diff(bounds) > 0))

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Elements and bounds of a list column's rows."""
    offs = column.offsets.to_numpy()
    return column.values.to_numpy().view(np.uint64)[offs[0] : offs[-1]], (offs - offs[0]).astype(np.int64)


def _slices(offs: np.ndarray, most: int, rows: int = 1 << 40) -> Iterator[tuple[int, int]]:
    """Rows [start, stop) of `most` elements together, or one row."""
    start, n = 0, len(offs) - 1
    while start < n:
        stop = min(start + rows, max(start + 1, int(np.searchsorted(offs, offs[start] + most, "right")) - 1))
        yield start, stop
        start = stop


def _keys(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offs = _flat(batch.column(1))
            for start, stop in _slices(offs, SLICE):
                doc, key = part_keys(values[offs[start] : offs[stop]], offs[start : stop + 1] - offs[start], percent)
                yield pa.RecordBatch.from_arrays([pa.array(tc.signed(key)), batch.column(0).take(pa.array(start + doc))], ["key", "doc_id"])

    return run


def _join_cells(percent: int):
    """Rows (cell, pivot, doc_id, label, el), a cell's together and its pivot first -> links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, first, ids, labels, sets = None, False, [], [], []

        def done() -> pa.RecordBatch:
            s = Sets(ids, sets, percent)
            place: dict[int, int] = {}
            for i, x in enumerate(labels):  # what has the same label is linked already
                s.union(i, place.setdefault(x, i))
            s.join(np.arange(len(ids)), 0 if first else None)
            out = [(a, b) for a, b in s.edges() if a != b]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=FOUND)

        for batch in batches:
            values, offs = _flat(batch.column(4))
            for k, (c, p, d, x) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(4)))):
                if c != cell:
                    if len(ids) > 1:
                        yield done()
                    cell, first, ids, labels, sets = c, p, [], [], []
                ids.append(d)
                labels.append(x)
                sets.append(values[offs[k] : offs[k + 1]].copy())
        if len(ids) > 1:
            yield done()

    return run


class Block:
    """Some sets: distances of any number of others to all of them.

    Elements that an eighth of the sets have (eight sets at least) are columns of a matrix, of eight times as many numbers as the
    sets have elements at most; the others are posting lists.
    """

    def __init__(self, ids: list[int], labels: list[int], sets: list[np.ndarray]):
        self.ids, self.labels = np.array(ids, np.int64), np.array(labels, np.int64)
        self.size = np.array([len(x) for x in sets])
        flat, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(flat, kind="stable")
        self.own = own[order]
        self.value, start, self.times = np.unique(flat[order], return_index=True, return_counts=True)
        self.start = start
        common = self.times * 8 >= max(len(ids), 64)
        self.column = np.where(common, np.cumsum(common) - 1, -1)
        self.matrix = np.zeros((len(ids), int(common.sum())), np.float32)
        column = np.repeat(self.column, self.times)
        self.matrix[self.own[column >= 0], column[column >= 0]] = 1
        known, self.label = np.unique(self.labels, return_inverse=True)
        self.place = dict(zip(known.tolist(), range(len(known))))
        self.root = np.arange(len(known))

    def shared(self, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(rows, sets) sizes of intersections, some rows or postings at a time: near copies share most elements with most sets."""
        at = np.minimum(np.searchsorted(self.value, values), len(self.value) - 1)
        hit = np.flatnonzero(self.value[at] == values)
        at, row = at[hit], np.searchsorted(bounds, hit, "right") - 1
        n, m = len(bounds) - 1, len(self.ids)
        out = np.zeros((n, m), np.int64)
        common = self.column[at] >= 0
        inside, column = row[common], self.column[at[common]]
        step = max(1, SLICE // max(1, self.matrix.shape[1]))
        for lo in range(0, n if len(inside) else 0, step):
            a, b = np.searchsorted(inside, [lo, lo + step])
            part = np.zeros((min(step, n - lo), self.matrix.shape[1]), np.float32)
            part[inside[a:b] - lo, column[a:b]] = 1
            out[lo : lo + step] = part @ self.matrix.T  # whole numbers, exact below 2**24
        at, row = at[~common], row[~common]
        first, times = self.start[at], self.times[at]
        for a, b in _slices(np.concatenate([[0], np.cumsum(times)]), SLICE):
            t, lo, hi = times[a:b], row[a], row[b - 1] + 1
            take = np.repeat(first[a:b] - (np.cumsum(t) - t), t) + np.arange(t.sum())
            out[lo:hi] += np.bincount(np.repeat(row[a:b] - lo, t) * m + self.own[take], minlength=(hi - lo) * m).reshape(-1, m)
        return out

    def join(self, hit: np.ndarray, ids: list[int], labels: list[int]) -> list[tuple[int, int]]:
        """Links of rows and the block's sets (hit: who links with whom) that join what neither labels nor links given
        before join: in all at most one for each row and one for each set."""
        out = []
        for i in np.flatnonzero(hit.any(axis=1)).tolist():
            own = self.root[self.place[labels[i]]] if labels[i] in self.place else -1
            sets = np.flatnonzero(hit[i])
            roots = self.root[self.label[sets]]
            new, at = np.unique(roots[roots != own], return_index=True)
            out += [(ids[i], b) for b in self.ids[sets[roots != own][at]].tolist()]
            if len(new) > (own < 0):
                self.root[np.isin(self.root, new)] = new[0] if own < 0 else own
        return out


def _deal(percent: int, level: int):
    """Rows (cell, chunk, pivot, doc_id, label, el, last), a chunk's pivots first -> links and the next cells' rows.

    Pivots that lie within 4 theta of each other form one region. A member belongs to the region of its nearest
    pivot and to each with a pivot in its window (nearest + 2 theta); members near none form a region of their own.
    Pivots themselves are settled: they have met every member. `last` cells end here: their block held all that was
    left to compare. A member within reach of a pivot takes its label.
    """
    theta = (100 - percent) / 100 + 1e-9
    names = ["cell", "doc_id", "label", "other", "el"]

    def regions(block: Block, values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = block.shared(values, bounds)
        dist = 1 - both / (block.size[:, None] + block.size[None, :] - both)
        return group(dist <= 4 * theta), group((dist <= theta) | (block.labels[:, None] == block.labels[None, :]))

    def group(linked: np.ndarray) -> np.ndarray:
        out = np.arange(len(linked))
        for _ in range(len(linked)):
            least = np.where(linked, out[None, :], len(out)).min(axis=1)
            if (least == out).all():
                break
            out = least
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, block, region, same = None, [], None, None, None
        for batch in batches:
            cells, chunks, pivot, ids, labels, last = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 6))
            values, offs = _flat(batch.column(5))
            start = 0
            while start < len(cells):
                if (cells[start], chunks[start]) != chunk:
                    chunk, held, block = (cells[start], chunks[start]), [], None
                if pivot[start]:
                    held.append((ids[start], labels[start], values[offs[start] : offs[start + 1]].copy()))
                    start += 1
                    continue
                stop = start + 1
                most = max(1, SLICE // max(1, len(held)))
                while stop < len(cells) and (cells[stop], chunks[stop]) == chunk and stop - start < most and offs[stop + 1] - offs[start] <= SLICE:
                    stop += 1
                if block is None:
                    block = Block(*map(list, zip(*held)))
                    if not last[start]:
                        region, same = regions(block, np.concatenate([h[2] for h in held]), np.concatenate([[0], np.cumsum(block.size)]))
                mine = values[offs[start] : offs[stop]], offs[start : stop + 1] - offs[start]
                both = block.shared(*mine)
                whole = np.diff(mine[1])[:, None] + block.size[None, :] - both
                hit = both * 100 >= percent * whole
                rows = [(None, a, None, b, None) for a, b in block.join(hit, ids[start:stop], labels[start:stop])]
                if not last[start]:
                    dist = 1 - both / whole
                    least = dist.min(axis=1)
                    near = (dist <= least[:, None] + 2 * theta) & (dist < 1)
                    for i in range(stop - start):
                        if (block.ids == ids[start + i]).any():
                            continue
                        label = int(block.labels[same[np.argmax(hit[i])]]) if hit[i].any() else labels[start + i]
                        to = [int(x) + 1 for x in np.unique(region[near[i]])] + ([0] if least[i] >= 1 - 2 * theta else [])
                        el = values[offs[start + i] : offs[start + i + 1]].view(np.int64)
                        for j in to:
                            mixed = tc.mix(np.array([(chunk[0] & (2**64 - 1)) ^ (level << 32 | j)], np.uint64)).view(np.int64)[0]
                            rows.append((int(mixed), ids[start + i], label, None, el))
                start = stop
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.list_(pa.int64()))], names)

    return run


def _divide(cells: DataFrame, percent: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Divide cells (cell, doc_id, label, el) until each has at most `most` elements: (what is left, links).

    A round takes up to PIVOTS members of unlike labels as pivots; once the members outside the commonest label have
    `most` elements at most, they are all pivots and the cell is done. Every round settles its pivots, so it ends.
    """
    found = None
    for level in range(1 << 20):
        by_label = cells.groupBy("cell", "label").agg(F.sum(F.size("el")).alias("w"), F.count("*").alias("n"))
        sizes = by_label.groupBy("cell").agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("labels"), F.max_by("label", "n").alias("common"), (F.sum("w") - F.max_by("w", "n")).alias("others"))
        sizes = cut_lineage(sizes)
        cells = cells.join(sizes.filter("labels > 1").select("cell"), "cell", "left_semi")
        large = sizes.filter((F.col("labels") > 1) & (F.col("w") > most) & (F.col("n") > LEAF)).withColumns({"last": F.col("others") <= most, "chunks": F.ceil(F.col("w") / most).cast("int")})
        if large.isEmpty():
            break
        big = cells.join(large.select("cell", "common", "last", "chunks"), "cell")
        row = F.struct("doc_id", "label", "el")
        slot = F.pmod(F.xxhash64("label", F.lit(level)), F.lit(PIVOTS))
        few = big.filter("not last").groupBy("cell", "last", "chunks", slot.alias("slot")).agg(F.min_by(row, F.xxhash64("doc_id", F.lit(level))).alias("p")).select("cell", "last", "chunks", "p.*")
        pivots = few.unionByName(big.filter("last and label <> common").select("cell", "last", "chunks", "doc_id", "label", "el"))
        pivots = pivots.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        members = big.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.col("chunks")).cast("int"))
        cols = ["cell", "chunk", "pivot", "doc_id", "label", "el", "last"]
        both = pivots.withColumn("pivot", F.lit(True)).select(cols).unionByName(members.withColumn("pivot", F.lit(False)).select(cols))
        ordered = both.repartition(partitions(cells.sparkSession), "cell", "chunk").sortWithinPartitions("cell", "chunk", F.desc("pivot"), "doc_id")
        parts = cut_lineage(ordered.mapInArrow(_deal(percent, level), "cell bigint, doc_id bigint, label bigint, other bigint, el array<bigint>"))
        links = parts.filter("other is not null").select(F.col("doc_id").alias("a"), F.col("other").alias("b"))
        found = links if found is None else found.unionByName(links)
        cells = cut_lineage(cells.join(large.select("cell"), "cell", "left_anti").unionByName(parts.filter("cell is not null").select("cell", "doc_id", "label", "el")))
    return cells, found


def links(candidates: DataFrame, *, percent: int, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """a, b: links that join the same documents as all links do. candidates: doc_id, el (sorted, distinct)."""
    spark = candidates.sparkSession
    keys = candidates.select("doc_id", "el").mapInArrow(_keys(percent), "key bigint, doc_id bigint")
    pivots = keys.groupBy("key").agg(F.min("doc_id").alias("cell"), F.max("doc_id").alias("last")).filter("last > cell").select("key", "cell")
    member = keys.join(pivots, "key").select("cell", "doc_id").distinct()
    member = cut_lineage(member)
    rows = member.join(candidates, "doc_id").select("cell", "doc_id", "el")
    heavy = member.join(candidates.select("doc_id", F.size("el").alias("n")), "doc_id").groupBy("cell").agg(F.sum("n").alias("w"), F.count("*").alias("n"))
    heavy = cut_lineage(heavy.filter((F.col("w") > cell_shingles) & (F.col("n") > LEAF)).select("cell"))
    label = F.col("doc_id").alias("label")
    pivot = (F.col("doc_id") == F.col("cell")).alias("pivot")

    def join(cells: DataFrame) -> DataFrame:
        ordered = cells.repartition(partitions(spark), "cell").sortWithinPartitions("cell", F.desc("pivot"), "doc_id")
        return ordered.mapInArrow(_join_cells(percent), "a bigint, b bigint")

    if heavy.isEmpty():
        return join(rows.select("cell", pivot, "doc_id", label, "el"))
    small = join(rows.join(heavy, "cell", "left_anti").select("cell", pivot, "doc_id", label, "el"))
    left, found = _divide(cut_lineage(rows.join(heavy, "cell", "left_semi").select("cell", "doc_id", label, "el")), percent, cell_shingles)
    out = small.unionByName(join(left.select("cell", F.lit(False).alias("pivot"), "doc_id", "label", "el")))
    return out if found is None else out.unionByName(found)


@frees_shuffles
def grouped(docs: DataFrame, make, percent: int, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """doc_id, n, component_id of the sets that `make` gives of each text; component_id is null for empty sets."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(partitions(spark), total // BUCKET_BYTES)
    sent = base.mapInArrow(_sets(make, buckets), SENT)
    to = F.coalesce("bucket", F.pmod("message", F.lit(buckets)).cast("int"))
    met = sent.withColumn("to", to).repartitionById(buckets, F.col("to")).drop("to").mapInArrow(_meet, SENT)
    made = met.repartition(partitions(spark), "message").sortWithinPartitions("message", F.asc_nulls_first("bucket")).mapInArrow(_sum, MADE)
    made = cut_lineage(made)
    same = ["n_shingles", "h1", "h2"]
    full = made.filter("n_shingles > 0 and doc_id is not null")
    reps = cut_lineage(full.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.max("c").alias("c")))
    some = reps.filter(F.col("c") * 100 >= F.col("n_shingles") * percent).select(F.col("rep").alias("doc_id")).distinct()
    some = cut_lineage(some)
    found = base.filter("doc_id is not null").join(F.broadcast(some) if some.count() <= BROADCAST_IDS else some, "doc_id", "left_semi")
    sets = found.mapInArrow(_elements(make), "doc_id bigint, h1 bigint, el array<bigint>").dropDuplicates(["doc_id", "h1"])
    near = components(links(cut_lineage(sets.select("doc_id", "el")), percent=percent, cell_shingles=cell_shingles)).withColumnRenamed("node", "rep")
    best = reps.join(near, "rep", "left").select(*same, F.least("rep", F.coalesce("component", "rep")).alias("component"))
    return made.join(best, same, "left").select("doc_id", F.col("n_shingles").alias("n"), F.col("component").alias("component_id"))


def jaccard_join(docs: DataFrame, *, shingle: int = 5, percent: int = 80, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked by 100 * |A & B| >= percent * |A | B|, closed transitively.

    Sets are distinct shingles of `shingle` words (A-Z lower-cased, split at ASCII white space); a shorter text is
    one shingle of all its words. Null, empty and blank texts have empty sets and link with nothing. Equal sets (by
    size and two independent 64-bit hashes) become one representative before anything is compared, so copies cost
    nothing. Rows that share a doc_id are one document; rows without one come out with the component of an equal set, or
    null. Repeated rows come out as often as they came in; an empty table gives an empty result; further columns are
    ignored.

    The join is exact for any `percent` above 0: no cap on partners or candidates. Distances are counted over the
    shingles' 64-bit hashes.
    """
    found = grouped(docs, functools.partial(shingle_sets, n=shingle), percent, cell_shingles)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
