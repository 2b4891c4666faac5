"""SentencePiece encoding by Gumbel top-k without replacement, and decoding.

The lattice of a text factorises at spaces and line feeds, which no piece crosses: units (a run of spaces with the
word after it) have small lattices of their own, built once for each distinct unit of a chunk. A segmentation is one
path through the units' lattices in a row. Perturbed A-star search: the root draws the largest Gumbel value; a path
drawn from the model inherits it; at each step of the path the edges not taken form one agenda item, whose value is a
Gumbel truncated at the path's value. Popping the best item gives the next distinct segmentation, exactly in the order
of perturbed log-probabilities, and all documents of a chunk advance together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathledger.llm import textcore as tc

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
SAMPLES = 2
THETA = 1.0
#: So few units or walks left are finished one by one; it changes no piece.
FEW = 8
#: Bytes of a unit for whose ends edges are drawn at once then.
STRETCH = 1 << 16


class Vocabulary:
    """Pieces as bytes with weights. A BPE model has merge ranks, not probabilities: weight = (rank + 2) ** -theta."""

    def __init__(self, path: str = MODEL, theta: float = THETA):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        self.theta, self.n = theta, n
        self.bytes_of: list[bytes] = []
        self.byte_id = np.zeros(256, np.int64)
        normal: dict[bytes, int] = {}
        for i in range(n):
            if m.is_byte(i):
                b = int(m.id_to_piece(i)[1:-1], 16)
                self.byte_id[b] = i
                self.bytes_of.append(bytes([b]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(m.id_to_piece(i).replace(SPACE, " ").encode())
                normal.setdefault(self.bytes_of[-1], i)
        self.weight = 1.0 / (np.arange(n) + 2.0) ** theta  # ids follow merge ranks
        self.most = max(map(len, normal))
        self.log_weight = np.log(self.weight)
        # every prefix of a piece is a state; step() walks all positions of a chunk at once
        self.states = sorted({p[:k] for p in normal for k in range(1, len(p) + 1)})
        self.piece = np.array([normal.get(k, -1) for k in self.states], np.int32)
        self._step: np.ndarray | None = None
        self._blob: tuple[np.ndarray, ...] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_step": None, "_blob": None}

    def step(self) -> np.ndarray:
        """(states + 1) x 256 transitions, -1 where none; the last row starts. Made once a process."""
        if self._step is None:
            index = {k: i for i, k in enumerate(self.states)}
            out = np.full((len(self.states) + 1, 256), -1, np.int32)
            for k, i in index.items():
                out[index[k[:-1]] if len(k) > 1 else len(self.states), k[-1]] = i
            self._step = out
        return self._step

    def spelled(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of many segmentations in a row, and their bounds: what decoding gives, with the leading space."""
        if self._blob is None:
            size = np.array([len(b) for b in self.bytes_of])
            self._blob = np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum(size) - size, size
        blob, start, size = self._blob
        n = size[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        return blob[np.repeat(start[ids] - total[:-1], n) + np.arange(total[-1])], total[bounds]


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of units: cut before a space that follows another byte, and around line feeds."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    if n:
        space, line = data == 32, data == 10
        cut[1:n] |= space[1:] & ~space[:-1]
        cut[1:n] |= line[1:] | line[:-1]
    at = np.flatnonzero(cut)
    start, end = at[:-1], at[1:]
    return start, end, np.searchsorted(offs, start, "right") - 1


def sum_paths(alpha: np.ndarray, first: int, at: np.ndarray, begin: np.ndarray, lw: np.ndarray) -> None:
    """Log-weights of all paths to each node from `first` on, node by node: for levels too narrow for a call each."""
    a, at_, b, w, none = memoryview(alpha), memoryview(at), memoryview(begin), memoryview(lw), -math.inf
    for node in range(first, len(a)):
        x = [a[b[e]] + w[e] for e in range(at_[node], at_[node + 1])]
        top = max(x, default=none)
        if top > none:
            a[node] = top + math.log(sum([math.exp(y - top) for y in x]))


class Lattice:
    """Edges of the distinct units of a chunk, grouped by end node, with P(edge | path goes through its end)."""

    def __init__(self, v: Vocabulary, data: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.first = np.cumsum(size) - size
        total_bytes = int(size.sum())
        take = np.repeat(start - self.first, size) + np.arange(total_bytes)
        self.data = data[take]
        n = total_bytes
        limit = np.repeat(self.first + size, size)
        flow, start_state = v.step(), len(v.states)
        width = np.repeat(np.array([1, 2, 3, 4]), [0xC0, 0x20, 0x10, 0x10])[self.data]
        alone = (self.data & 0xC0) == 0x80
        pos, state = np.arange(n), np.full(n, start_state, np.int32)
        ways = np.zeros(n, np.int16)  # edges that end with each byte, so far
        found = []  # (first byte, last byte, rank among the edges of that end, piece), in this order no sort is needed

        def add(first: np.ndarray, last: np.ndarray, piece: np.ndarray) -> None:
            found.append((first, last, ways[last], piece))
            ways[last] += 1

        for k in range(v.most):
            live = np.flatnonzero(pos + k < limit[pos]) if k else np.arange(n)
            pos = pos[live]
            state = flow[state[live], self.data[pos + k]]
            on = state >= 0
            pos, state = pos[on], state[on]
            if not len(pos):
                break
            p = v.piece[state]
            hit = p >= 0
            at = pos[hit]
            add(at, at + k, p[hit])
            alone[at[width[at] == k + 1]] = True
        # bytes of characters that no piece spells alone: one edge a byte
        lead = np.flatnonzero((self.data & 0xC0) != 0x80)
        owner_char = np.cumsum((self.data & 0xC0) != 0x80) - 1
        raw = np.flatnonzero(~alone[lead][np.maximum(owner_char, 0)]) if len(lead) else np.arange(n)
        add(raw, raw, v.byte_id[self.data[raw]])
        # node ids run by depth and, within one, over the units that are long enough, longest first: edges grouped by
        # end node are then grouped by level as well
        units_n, most = len(size), int(size.max(initial=0))
        by_size = np.argsort(-size, kind="stable")
        place = np.empty(units_n, np.int64)
        place[by_size] = np.arange(units_n)
        alive = np.searchsorted(-size[by_size], -np.arange(most + 1), "right")  # units of at least d bytes
        level = np.concatenate([[0], np.cumsum(alive)])
        owner = np.repeat(place, size)
        offset = np.arange(n) - np.repeat(self.first, size)
        before, after = (level[offset] + owner).astype(np.int32), (level[offset + 1] + owner).astype(np.int32)
        self.root = place
        self.sink = level[size] + place
        nodes = int(level[-1])
        self.roots, self.level = units_n, level
        self.depth = np.repeat(np.arange(most + 1, dtype=np.int32), alive)
        into = np.zeros(nodes, np.int64)
        into[after] = ways
        self.at = np.concatenate([[0], np.cumsum(into)])
        self.begin, self.end, self.piece = (np.zeros(int(self.at[-1]), np.int32) for _ in range(3))
        for first, last, rank, piece in found:
            to = self.at[after[last]] + rank
            self.begin[to], self.end[to], self.piece[to] = before[first], after[last], piece
        lw = v.log_weight[self.piece]
        alpha = np.full(nodes, -np.inf)
        alpha[: self.roots] = 0.0
        few = max(int(np.searchsorted(-alive, -FEW)), 1)  # the first level of few nodes
        for d in range(1, min(few, most + 1)):
            e = slice(self.at[level[d]], self.at[level[d + 1]])
            if e.start == e.stop:
                continue
            x = alpha[self.begin[e]] + lw[e]
            node = self.end[e]
            heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            top = np.maximum.reduceat(x, heads)
            top = np.where(np.isfinite(top), top, 0.0)
            run = np.diff(np.append(heads, len(x)))
            with np.errstate(divide="ignore"):
                alpha[node[heads]] = np.log(np.add.reduceat(np.exp(x - np.repeat(top, run)), heads)) + top
        if few <= most:
            sum_paths(alpha, int(level[few]), self.at, self.begin, lw)
        lw += alpha[self.begin]
        lw -= alpha[self.end]
        self.log_p, self.p = lw, np.exp(lw)

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge into each node, by its probability."""
        e, last = self.at[node], self.at[node + 1] - 1
        want = u - self.p[e]
        todo = np.flatnonzero((want > 0) & (e < last))
        while len(todo):
            e[todo] += 1
            want[todo] -= self.p[e[todo]]
            todo = todo[(want[todo] > 0) & (e[todo] < last[todo])]
        return e

    def follow(self, root: int, node: int, seed: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """(edges, hashes) of one walk from a node to the root of its unit: edges are drawn for all ends of a stretch, then followed."""
        edges, hashes, depth = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], int(self.depth[node])
        while depth:
            low = max(depth - STRETCH, 0)
            d = np.arange(low + 1, depth + 1)
            ends, h = self.level[d] + root, keyed(seed, d)
            open_ = self.at[ends + 1] > self.at[ends]  # none ends inside a character that a piece spells
            e = np.zeros(len(d), np.int64)
            e[open_] = self.draw(ends[open_], uniform(h[open_]))
            before, taken = self.depth[self.begin[e]].tolist(), []
            while depth > low:
                taken.append(depth - low - 1)
                depth = before[taken[-1]]
            edges.append(e[taken])
            hashes.append(h[taken])
        return np.concatenate(edges), np.concatenate(hashes)

    def log_rest(self, e: np.ndarray) -> np.ndarray:
        """Log-probability of the other edges into the same node; -inf where there are none."""
        rest = 1 - self.p[e]
        none = (rest < 1e-12) | (self.at[self.end[e] + 1] - self.at[self.end[e]] < 2)
        return np.where(none, -np.inf, np.log(np.maximum(rest, 1e-300)))


def uniform(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((h >> tc.U(11)).astype(float) + 0.5) * 2.0**-53


def keyed(seed: np.ndarray, *numbers) -> np.ndarray:
    """A hash of a seed and numbers of any size."""
    h = seed
    for k, x in enumerate(numbers):
        h = tc.mix(h + np.asarray(x).astype(np.uint64) * tc.GRAM[52 + k])
    return h


def truncated(value: np.ndarray, top: np.ndarray) -> np.ndarray:
    """A Gumbel value as it is given that it is at most `top`; greater values stay greater."""
    return -np.logaddexp(-top, -value)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... size[i] numbers each, in a row."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def best(value: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """(segments, n) places of the greatest values in each segment [at[i], at[i + 1]), best first; -1 where none is finite."""
    out = np.full((len(at) - 1, n), -1, np.int64)
    full = np.flatnonzero(at[1:] > at[:-1])
    if not len(full):
        return out
    value, size = value.copy(), np.diff(at)[full]
    for k in range(n):
        top = np.maximum.reduceat(value, at[full])
        hit = np.where(value == np.repeat(top, size), np.arange(len(value)), len(value))
        place = np.minimum.reduceat(hit, at[full])
        ok = np.isfinite(top)
        out[full[ok], k] = place[ok]
        value[place[ok]] = -np.inf
    return out


class Path:
    """One segmentation for each of some documents: edges in the order of the walk, with their units."""

    def __init__(self, docs: np.ndarray, at: np.ndarray, edges: np.ndarray, units: np.ndarray, log_prob: np.ndarray):
        self.docs, self.at, self.edges, self.units, self.log_prob = docs, at, edges, units, log_prob

    def pieces(self, lat: Lattice) -> np.ndarray:
        """Piece ids in text order: the walk goes through each unit from its end."""
        if not len(self.units):
            return lat.piece[self.edges]
        head = np.flatnonzero(np.concatenate([[True], self.units[1:] != self.units[:-1]]))
        size = np.diff(np.append(head, len(self.units)))
        return lat.piece[self.edges[np.repeat(2 * head + size - 1, size) - np.arange(len(self.units))]]


def sample_chunk(v: Vocabulary, data: np.ndarray, offs: np.ndarray, seeds: np.ndarray, k: int) -> tuple[Lattice, list[Path], np.ndarray]:
    """(lattice, the k best perturbed segmentations as one Path each, the next perturbed value of each document).

    Agenda items are (value, turn, place, log-probability of the edges before the place, edges taken there): an item
    points into the path that it leaves, so nothing is copied. All documents advance together.
    """
    docs = len(offs) - 1
    start, end, owner = units(data, offs)
    h, _, _, _ = tc.words(data, np.append(start, len(data)), np.ones(256, bool), lower=False)
    _, one, inverse = np.unique(h, return_index=True, return_inverse=True)
    lat = Lattice(v, data, start[one], (end - start)[one])
    first_unit = np.searchsorted(owner, np.arange(docs + 1))
    sink, root = lat.sink[inverse], lat.root[inverse]

    def walk(unit: np.ndarray, node: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, edge, hash) of fresh walks from each node to the root of its unit, entries in order."""
        seed = keyed(seeds[owner[unit]], turn, unit - first_unit[owner[unit]])
        who, parts = np.arange(len(unit)), []
        go = node != root[unit]
        node, who = node[go], who[go]
        while len(node) > FEW:
            h = keyed(seed[who], lat.depth[node])
            e = lat.draw(node, uniform(h))
            parts.append((who, e, h))
            node = lat.begin[e]
            go = node != root[unit[who]]
            node, who = node[go], who[go]
        rest = [(w, *lat.follow(int(root[unit[w]]), x, seed[w])) for w, x in zip(who.tolist(), node.tolist())]
        size = np.zeros(len(unit), np.int64)
        for who, _, _ in parts:
            size[who] += 1
        for w, e, _ in rest:
            size[w] += len(e)
        before = np.cumsum(size) - size
        edges, hashes = np.zeros(int(size.sum()), np.int64), np.zeros(int(size.sum()), np.uint64)
        for step, (who, e, h) in enumerate(parts):
            edges[before[who] + step], hashes[before[who] + step] = e, h
        for w, e, h in rest:
            to = slice(before[w] + len(parts), before[w] + len(parts) + len(e))
            edges[to], hashes[to] = e, h
        return np.repeat(np.arange(len(unit)), size), edges, hashes

    top = -np.log(-np.log(uniform(keyed(seeds, 0, 0, 1))))
    now = np.arange(docs)
    prefix_at, prefix_turn, prefix_lp = np.zeros(docs, np.int64), np.full(docs, -1), np.zeros(docs)
    pick, pick_unit = np.zeros(docs, np.int64), np.full(docs, -1)
    item_value = np.full((docs, k + 1), -np.inf)
    item_turn, item_at = np.zeros((docs, k + 1), np.int64), np.zeros((docs, k + 1), np.int64)
    item_lp, item_taken = np.zeros((docs, k + 1)), np.full((docs, k + 1, k), -1, np.int64)
    paths: list[Path] = []
    for turn in range(k):
        # what to draw: the rest of the unit where the path leaves another, then all units after it
        fresh = np.where(pick_unit < 0, first_unit[now], pick_unit + 1)
        more = first_unit[now + 1] - fresh
        part = (pick_unit >= 0).astype(np.int64)
        entry = ragged(fresh - part, more + part)
        node = sink[entry].copy()
        heads = np.cumsum(more + part) - more - part
        node[heads[part > 0]] = lat.begin[pick[part > 0]]
        who, e, h = walk(entry, node, turn + 1)
        job = np.repeat(np.arange(len(now)), more + part)[who]
        at = np.searchsorted(job, np.arange(len(now) + 1))
        # the whole path: old edges, the edge taken instead, fresh ones
        lead, fresh_n = prefix_at + part, np.diff(at)
        path_at = np.concatenate([[0], np.cumsum(lead + fresh_n)])
        edges, unit = np.zeros(path_at[-1], np.int64), np.zeros(path_at[-1], np.int64)
        for t in range(turn):
            j = np.flatnonzero(prefix_turn == t)
            old = paths[t]
            source = ragged(old.at[np.searchsorted(old.docs, now[j])], prefix_at[j])
            to = ragged(path_at[j], prefix_at[j])
            edges[to], unit[to] = old.edges[source], old.units[source]
        j = np.flatnonzero(part)
        edges[path_at[j] + prefix_at[j]], unit[path_at[j] + prefix_at[j]] = pick[j], pick_unit[j]
        to = ragged(path_at[:-1] + lead, fresh_n)
        edges[to], unit[to] = e, entry[who]
        # items: at each fresh step the edges not taken
        lp = lat.log_p[e]
        total = np.concatenate([[0], np.cumsum(lp)])
        before = total[:-1] - np.repeat(total[at[:-1]] - prefix_lp, fresh_n)
        value = before + lat.log_rest(e) - np.log(-np.log(uniform(tc.mix(h ^ tc.GRAM[59]))))
        paths.append(Path(now, path_at, edges, unit, prefix_lp + total[at[1:]] - total[at[:-1]]))
        need = k - turn
        found = best(value, at, need)
        ok = found >= 0
        place = np.maximum(found, 0)
        fill = lambda a: np.where(ok, a[place], 0) if len(a) else np.zeros(place.shape)
        with np.errstate(invalid="ignore"):
            new_value = np.where(ok, truncated(np.where(ok, fill(value), 0.0), top[now][:, None]), -np.inf)
        new_at = place - at[:-1, None] + lead[:, None]
        all_value = np.concatenate([item_value[now], new_value], axis=1)
        order = np.argsort(-all_value, axis=1, kind="stable")[:, : k + 1]
        pull = lambda old, new: np.take_along_axis(np.concatenate([old[now], new], axis=1), order, axis=1)
        turns, places, lps = pull(item_turn, np.full(place.shape, turn)), pull(item_at, new_at), pull(item_lp, fill(before))
        taken = np.full((len(now), need, k), -1, np.int64)
        taken[:, :, 0] = fill(e)
        taken = np.take_along_axis(np.concatenate([item_taken[now], taken], axis=1), order[:, :, None], axis=1)
        item_value[now] = np.take_along_axis(all_value, order, axis=1)
        item_turn[now], item_at[now], item_lp[now], item_taken[now] = turns, places, lps, taken
        if turn == k - 1:
            break
        # pop the best item: one of the edges not taken there, by probability; what is left stays an item
        now = np.flatnonzero(np.isfinite(item_value[:, 0]))
        if not len(now):
            break
        top[now] = item_value[now, 0]
        prefix_turn, prefix_at, prefix_lp, gone = item_turn[now, 0], item_at[now, 0], item_lp[now, 0], item_taken[now, 0]
        there, pick_unit = np.zeros(len(now), np.int64), np.zeros(len(now), np.int64)
        for t in range(turn + 1):
            j = np.flatnonzero(prefix_turn == t)
            x = paths[t].at[np.searchsorted(paths[t].docs, now[j])] + prefix_at[j]
            there[j], pick_unit[j] = lat.end[paths[t].edges[x]], paths[t].units[x]
        size = lat.at[there + 1] - lat.at[there]
        option = ragged(lat.at[there], size)
        p = lat.p[option].copy()
        p[(option[:, None] == np.repeat(gone, size, axis=0)).any(axis=1)] = 0
        head = np.cumsum(size) - size
        whole = np.add.reduceat(p, head)
        reach = np.cumsum(p) - np.repeat(np.cumsum(p)[head] - p[head], size)
        want = uniform(keyed(seeds[now], turn + 1, 1, 2)) * whole
        pick = option[best(np.where(p > 0, np.where(reach > np.repeat(want, size), 2.0, 1.0) - np.arange(len(p)) / (4.0 * len(p)), -np.inf), np.append(head, len(p)), 1)[:, 0]]
        left = 1 - np.where(gone >= 0, lat.p[np.maximum(gone, 0)], 0).sum(axis=1) - lat.p[pick]
        stays = (left > 1e-12) & (size > (gone >= 0).sum(axis=1) + 1)
        gumbel = -np.log(-np.log(uniform(keyed(seeds[now], turn + 1, 1, 3))))
        item_value[now, 0] = np.where(stays, truncated(prefix_lp + np.log(np.maximum(left, 1e-300)) + gumbel, top[now]), -np.inf)
        item_taken[now, 0, (gone >= 0).sum(axis=1)] = pick
        prefix_lp = prefix_lp + lat.log_p[pick]
    return lat, paths, item_value.max(axis=1)


SCHEMA = "doc_id bigint, rank int, n_pieces int, log_prob double, inclusion double, round_trip boolean, ids_sha256 string"


def encode(docs: DataFrame, *, model: str = MODEL, samples: int = SAMPLES, theta: float = THETA, seed: int = 0, with_ids: bool = False, chunk_bytes: int = 2 * tc.CHUNK) -> DataFrame:
    """Up to `samples` distinct segmentations of each whole text: one row each, rank 0 first.

    log_prob is the segmentation's log-probability under the lattice, inclusion the probability 1 - exp(-exp(log_prob
    - kappa)) that it is among the sampled ones, kappa being the next perturbed value (1 where nothing is left).
    round_trip tells whether decoding gives the text back. The draw depends on the text's own doc_id and `seed`
    alone. `chunk_bytes` of text have their lattice held at once; it changes no piece, and the two figures only in their
    last digits. Null and empty texts have one segmentation, of the leading space. Repeated rows repeat; an empty table
    gives an empty result; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model, theta))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        names = ["doc_id", "rank", "n_pieces", "log_prob", "inclusion", "round_trip", "ids_sha256", "ids"]
        for batch in batches:
            ids = batch.column(0)
            for lo, data, offs in tc.chunks(batch.column(1), chunk_bytes):
                n = len(offs) - 1
                framed = np.insert(data, offs[:-1], 32)  # the space that encoding puts in front of every text
                at = offs + np.arange(n + 1)
                key = ids.slice(lo, n).fill_null(-1).to_numpy().view(np.uint64)
                lat, paths, kappa = sample_chunk(v, framed, at, tc.mix(key + tc.U(seed) * tc.GRAM[61] + tc.U(1)), samples)
                for rank, path in enumerate(paths):
                    pieces = path.pieces(lat).astype(np.int32)
                    got, to = v.spelled(pieces, path.at)
                    rows = len(path.docs)
                    if rows == n and np.array_equal(to, at):
                        wrong = np.concatenate([[0], np.cumsum(got != framed)])
                        back = wrong[at[1:]] == wrong[at[:-1]]
                    else:
                        back = np.array([np.array_equal(got[to[i] : to[i + 1]], framed[at[d] : at[d + 1]]) for i, d in enumerate(path.docs)], bool)
                    with np.errstate(over="ignore"):
                        inclusion = np.where(np.isfinite(kappa[path.docs]), -np.expm1(-np.exp(np.minimum(path.log_prob - kappa[path.docs], 700.0))), 1.0)
                    edge = path.at.tolist()
                    digest = [hashlib.sha256(pieces[a:b]).hexdigest() for a, b in zip(edge, edge[1:])]
                    out = [ids.slice(lo, n).take(pa.array(path.docs)), pa.array(np.full(rows, rank, np.int32)), pa.array(np.diff(path.at).astype(np.int32)), pa.array(path.log_prob), pa.array(inclusion), pa.array(back), pa.array(digest, pa.string())]
                    if with_ids:
                        out.append(pa.ListArray.from_arrays(pa.array(path.at, pa.int32()), pa.array(pieces)))
                    yield pa.RecordBatch.from_arrays(out, names[: len(out)])

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)


def decode(encoded: DataFrame, *, model: str = MODEL) -> DataFrame:
    """doc_id, rank, text from doc_id, rank, ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2).fill_null([])
            flat, at = ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
            got, to = shared.value.spelled(flat.astype(np.int64), at)
            texts = [got[a + 1 : b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(to.tolist(), to[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "rank", "text"])

    return encoded.select("doc_id", "rank", "ids").mapInArrow(run, "doc_id bigint, rank int, text string")
