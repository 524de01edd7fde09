"""Pairs of vectors within a distance, found by one task among those that it holds.

Vectors come rotated and rounded to whole numbers ("codes"), so a squared distance is a sum
of squares of integers, exact in doubles in whatever order and batch it is computed. A pair
within `most` is within its share of that in at least one block of coordinates. Each block is
joined by range on its own: the held vectors are halved again and again along the coordinate
in which they spread widest, and the others follow to each half that they are within the
radius of. A pair that meets in several blocks counts in the first of them only.

Where very many vectors are within reach of one, all pairs of such a group are compared as a
whole instead, and blocks have the other pairs. Which groups there are is found from a part
of the vectors and decides about work only: each pair is compared in exactly one way.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np

#: The code of 1: a coordinate of a unit vector fits 16 bits.
SCALE = 32767
#: Vectors that are not halved any more, and what they are compared with at a time.
LEAF, TILE = 192, 2048
#: Pairs whose distances are computed at a time.
PAIRS = 1 << 14
#: Vectors among which groups are sought, at most and one of how many; the least of them in a group; the most groups.
SOUGHT, SOUGHT_OF, GROUP_LEAST, GROUPS = 8192, 32, 8, 64
#: What rounding adds to a sum of single-precision products of unit vectors, for each of them, at most.
ROUNDING = 5e-7

_Meet = Callable[[np.ndarray, np.ndarray], None]


def block_edges(size: int, blocks: int) -> np.ndarray:
    return np.linspace(0, size, min(blocks, size) + 1).astype(int)


class Reach(NamedTuple):
    """Squared distances of codes: none that links is over `most`, all up to `sure` do."""

    edges: np.ndarray
    most: int
    sure: int

    @staticmethod
    def of(size: int, threshold: float, blocks: int) -> Reach:
        far = np.sqrt(max(0.0, 2 - 2 * threshold)) * SCALE
        off = np.sqrt(size) + 1e-9 * SCALE  # each code of a pair is off by half at most
        return Reach(block_edges(size, blocks), int((far + off) ** 2) + 1, int((far - off) ** 2) - 1 if far > off else -1)


def _scaled(codes: np.ndarray) -> np.ndarray:
    """[x, 1, |x|^2] of each row."""
    width = codes.shape[1]
    out = np.empty((len(codes), width + 2), np.float32)
    np.divide(codes, np.float32(SCALE), out=out[:, :width], casting="unsafe")
    out[:, width] = 1
    np.einsum("ij,ij->i", out[:, :width], out[:, :width], out=out[:, width + 1])
    return out


def _against(x: np.ndarray) -> np.ndarray:
    """What gives squared distances as a product with rows of `_scaled`."""
    width = x.shape[1] - 2
    out = np.empty_like(x)
    np.multiply(x[:, :width], -2, out=out[:, :width])
    out[:, width], out[:, width + 1] = x[:, width + 1], 1
    return out


class Links:
    """Links among `ids`: how many each row has, by weight, and which rows they connect."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, codes: Callable[[np.ndarray], np.ndarray], reach: Reach):
        self.ids, self.weights, self.codes, self.reach = ids, weights, codes, reach
        self.counts = np.zeros(len(ids), np.int64)
        self.root = np.arange(len(ids))
        self.close: list[tuple[np.ndarray, np.ndarray]] = []

    def find(self, rows: np.ndarray) -> np.ndarray:
        found = self.root[rows]
        while ((further := self.root[found]) != found).any():
            found = further
        self.root[rows] = found
        return found

    def connect(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            at, other = self.find(a), self.find(b)
            apart = at != other
            a, b, at, other = a[apart], b[apart], at[apart], other[apart]
            np.minimum.at(self.root, np.maximum(at, other), np.minimum(at, other))

    def compare(self, a: np.ndarray, b: np.ndarray, block: int | None = None) -> None:
        """Adds those of the pairs that link and, with a block, do not meet in an earlier one."""
        blocks = len(self.reach.edges) - 1
        for start in range(0, len(a), PAIRS):
            x, y = a[start : start + PAIRS], b[start : start + PAIRS]
            apart = self.codes(x).astype(np.float64)
            apart -= self.codes(y)
            apart *= apart
            squares = np.add.reduceat(apart, self.reach.edges[:-1], axis=1)
            total = squares.sum(axis=1)
            fits = total <= self.reach.most
            if block is not None:
                fits &= (squares * blocks <= self.reach.most).argmax(axis=1) == block
            sure = fits & (total <= self.reach.sure)
            fits &= ~sure
            if fits.any():
                self.close.append((self.ids[x[fits]], self.ids[y[fits]]))
            x, y = x[sure], y[sure]
            np.add.at(self.counts, x, self.weights[y])
            np.add.at(self.counts, y, self.weights[x])
            self.connect(x, y)

    def table(self, linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Adds the links of rows a with rows b that are set in the table `linked`."""
        counted = linked.astype(np.float64)
        self.counts[a] += (counted @ self.weights[b]).astype(np.int64)
        self.counts[b] += (self.weights[a] @ counted).astype(np.int64)
        while True:
            at, other = self.find(a), self.find(b)
            if at.min() == max(at.max(), other.max()) and at[0] == other.min():
                return
            apart = linked & (at[:, None] != other[None, :])
            rows, columns = np.flatnonzero(apart.any(axis=1)), np.flatnonzero(apart.any(axis=0))
            if not len(rows):
                return
            self.connect(a[rows], b[apart[rows].argmax(axis=1)])
            self.connect(a[apart[:, columns].argmax(axis=0)], b[columns])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(id, id of the smallest that it reaches, links) of rows with links; (id, id) of pairs that codes do not decide."""
        linked = np.flatnonzero(self.counts)
        root = self.find(linked)
        least = np.full(len(self.ids), np.iinfo(np.int64).max)
        np.minimum.at(least, root, self.ids[linked])
        none = np.zeros(0, np.int64)
        a, b = (np.concatenate([none, *(pair[i] for pair in self.close)]) for i in (0, 1))
        return self.ids[linked], least[root], self.counts[linked], a, b


class _Block:
    """Joins rows by range in one block; `meet` gets the rows of pairs that are in it, and perhaps some just beyond."""

    def __init__(self, reach: Reach, block: int, meet: _Meet):
        self.width = int(reach.edges[block + 1] - reach.edges[block])
        share = reach.most / (len(reach.edges) - 1) / SCALE**2
        self.limit = np.float32(share + (self.width + 2) * ROUNDING)
        self.radius = np.float32(np.sqrt(share) + 1e-5)
        self.meet = meet

    def _compare(self, xa, a, xb, b, upper: bool = False) -> None:
        for start in range(0, len(a), LEAF):
            part = _against(xa[start : start + LEAF])
            for at in range(start if upper else 0, len(b), TILE):
                near = part @ xb[at : at + TILE].T <= self.limit
                if upper and at < start + len(part):
                    near &= np.arange(at, at + near.shape[1]) > np.arange(start, start + len(part))[:, None]
                if len(hits := np.flatnonzero(near)):
                    i, j = np.divmod(hits, near.shape[1])
                    self.meet(a[start + i], b[at + j])

    def _box(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.width].min(axis=0), x[:, : self.width].max(axis=0)

    def _near(self, low: np.ndarray, high: np.ndarray, x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those rows that are within the radius of a box."""
        values = x[:, : self.width]
        gap = np.maximum(values - high, low - values)
        np.maximum(gap, 0, out=gap)
        near = np.flatnonzero(np.einsum("ij,ij->i", gap, gap) <= self.radius * self.radius)
        return (x, rows) if len(near) == len(rows) else (x.take(near, axis=0), rows.take(near))

    def _halves(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[int, np.ndarray]:
        """The widest coordinate, and which rows lie in its lower half."""
        k = int((high - low).argmax())
        middle = np.partition(x[:, k], len(x) // 2)[len(x) // 2]
        lower = x[:, k] < middle
        return k, lower if lower.any() else x[:, k] <= middle

    def across(self, xa: np.ndarray, a: np.ndarray, xb: np.ndarray, b: np.ndarray) -> None:
        """Pairs of rows a and b."""
        if not (len(a) and len(b)):
            return
        low, high = self._box(xa)
        todo = [(xa, a, *self._near(low, high, xb, b), low, high)]
        while todo:
            xa, a, xb, b, low, high = todo.pop()
            if len(a) <= LEAF or len(a) * len(b) <= LEAF * LEAF or (high - low).max() <= self.radius:
                if len(a) and len(b):
                    self._compare(xa, a, *self._near(*self._box(xa), xb, b))
                continue
            k, lower = self._halves(xa, low, high)
            column = xb[:, k]
            for half, below in ((np.flatnonzero(lower), True), (np.flatnonzero(~lower), False)):
                part = xa.take(half, axis=0)
                inner, outer = low.copy(), high.copy()
                inner[k], outer[k] = part[:, k].min(), part[:, k].max()
                to = np.flatnonzero(column <= outer[k] + self.radius if below else column >= inner[k] - self.radius)
                todo.append((part, a.take(half), xb.take(to, axis=0), b.take(to), inner, outer))

    def within(self, x: np.ndarray, rows: np.ndarray) -> None:
        """Pairs among the rows, each once."""
        todo = [(x, rows)]
        while todo:
            x, rows = todo.pop()
            if not len(rows):
                continue
            low, high = self._box(x)
            if len(rows) <= LEAF or (high - low).max() <= self.radius:
                self._compare(x, rows, x, rows, upper=True)
                continue
            k, lower = self._halves(x, low, high)
            column = x[:, k]
            border, other = column[lower].max(), column[~lower].min()
            parts = [np.flatnonzero(m) for m in (lower, ~lower, lower & (column >= other - self.radius), ~lower & (column <= border + self.radius))]
            first, second, *edges = [(x.take(at, axis=0), rows.take(at)) for at in parts]
            todo += [first, second]
            self.across(*edges[0], *edges[1])


def leaders(codes: np.ndarray, reach: Reach) -> np.ndarray:
    """Codes that very many others are within reach of, the most frequented first."""
    step = max(1, -(-len(codes) // SOUGHT), min(SOUGHT_OF, len(codes) // 2048))
    some = _scaled(codes[::step])
    limit = np.float32(reach.most / SCALE**2)
    near = np.concatenate([_against(some[i : i + 512]) @ some.T <= limit for i in range(0, len(some), 512)])
    left, found = near.sum(axis=1), []
    while len(found) < GROUPS and left.max() >= GROUP_LEAST:
        found.append(int(left.argmax()))
        left -= near[:, members := np.flatnonzero(near[found[-1]])].sum(axis=1)
        near[:, members] = False
    return codes[::step][found]


def grouped(codes: np.ndarray, heads: np.ndarray, reach: Reach) -> np.ndarray:
    """The number of the nearest leader that a row is within reach of, or -1."""
    group = np.full(len(codes), -1, np.int16)
    if len(heads):
        by, limit = _scaled(heads), np.float32(reach.most / SCALE**2)
        for start in range(0, len(codes), 8192):
            apart = _against(_scaled(codes[start : start + 8192])) @ by.T
            best = apart.argmin(axis=1)
            group[start : start + 8192] = np.where(apart[np.arange(len(best)), best] <= limit, best, -1)
    return group


def _whole(links: Links, a: np.ndarray, b: np.ndarray, upper: bool = False) -> None:
    """Compares all rows a with all rows b; with `upper`, which has them the same, each pair once."""
    if not (len(a) and len(b)):
        return
    reach = links.reach
    slack = (int(reach.edges[-1]) + 2) * ROUNDING
    sure, most = np.float32(reach.sure / SCALE**2 - slack), np.float32(reach.most / SCALE**2 + slack)
    for at in range(0, len(b), TILE):
        by, columns = _scaled(links.codes(b[at : at + TILE])), b[at : at + TILE]
        for start in range(0, min(len(a), at + len(columns)) if upper else len(a), 512):
            rows = a[start : start + 512]
            apart = _against(_scaled(links.codes(rows))) @ by.T
            if upper and at < start + len(rows):
                apart[np.arange(at, at + len(columns)) <= np.arange(start, start + len(rows))[:, None]] = np.inf
            linked = apart <= sure
            i, j = np.nonzero((apart <= most) & ~linked)
            links.table(linked, rows, columns)
            links.compare(rows[i], columns[j])


def _blocks(links: Links, groups: int, home: np.ndarray, home_group: np.ndarray, guests: np.ndarray | None = None, guest_group: np.ndarray | None = None) -> None:
    """All pairs but those of one group, by blocks."""
    ours = [np.flatnonzero(home_group == g) for g in range(-1, groups)]
    theirs = None if guests is None else [np.flatnonzero(guest_group == g) for g in range(-1, groups)]
    for block in range(len(links.reach.edges) - 1):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def flush(block=block, held=held) -> None:
            if held:
                links.compare(*(np.concatenate([pair[i] for pair in held]) for i in (0, 1)), block)
                held.clear()

        def meet(a, b, held=held, flush=flush) -> None:
            nonlocal waiting
            held.append((a, b))
            waiting += len(a)
            if waiting >= PAIRS:
                flush()
                waiting = 0

        join = _Block(links.reach, block, meet)
        low, high = links.reach.edges[block], links.reach.edges[block + 1]
        x = _scaled(home[:, low:high])
        if guests is None:
            join.within(x[ours[0]], ours[0])
            for g, rows in enumerate(ours[1:], 1):
                others = np.concatenate([ours[0], *ours[g + 1 :]])
                join.across(x[rows], rows, x[others], others)
        else:
            y = _scaled(guests[:, low:high])
            for g, rows in enumerate(ours):
                others = np.concatenate([to for k, to in enumerate(theirs) if k != g or not g])
                join.across(x[rows], rows, y[others], others + len(home))
        flush()


class Region:
    """Vectors that one task holds: (ids, weights, codes); `heads` are its leaders."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, codes: np.ndarray, threshold: float, blocks: int):
        self.ids, self.weights, self.home = ids, weights, codes
        self.reach = Reach.of(codes.shape[1], threshold, blocks)
        self.heads = leaders(codes, self.reach)
        self.group = grouped(codes, self.heads, self.reach)

    def own(self) -> Links:
        """Links among the held vectors."""
        links = Links(self.ids, self.weights, lambda rows: self.home[rows], self.reach)
        for g in range(len(self.heads)):
            rows = np.flatnonzero(self.group == g)
            _whole(links, rows, rows, upper=True)
        _blocks(links, len(self.heads), self.home, self.group)
        return links

    def guests(self, ids: np.ndarray, weights: np.ndarray, codes: np.ndarray) -> Links:
        """Links of the held vectors with others."""
        group, n = grouped(codes, self.heads, self.reach), len(self.ids)

        def both(rows: np.ndarray) -> np.ndarray:
            if not len(rows) or rows[0] < n:
                return self.home[rows]
            return codes[rows - n]

        links = Links(np.concatenate([self.ids, ids]), np.concatenate([self.weights, weights]), both, self.reach)
        for g in range(len(self.heads)):
            _whole(links, np.flatnonzero(self.group == g), np.flatnonzero(group == g) + n)
        _blocks(links, len(self.heads), self.home, self.group, codes, group)
        return links
