"""Density clusters of whole groups of any size: exact, without the distances of most pairs.

Copies are one vector with a weight. The distinct vectors of a group lie in blocks of like vectors, and in a block in leaves of ``LEAF``
like vectors; the greatest and least values of a leaf bound the distance of any vector to all of its vectors at once, so only pairs that
can matter are compared. A task has a pair of blocks, twice: first for the nearest vectors of each vector, then for the edges between
the parts that these leave. A part is joined by its lightest known edge where no unknown edge can be lighter; between two
parts only edges that are lighter than the way between them over known edges are sought. So the lightest spanning tree is that over all
pairs, and nothing is left out. Its edges, one a vector, are read off in one task.

Vectors that are counts at length one, as those of hashed words, have exact products from whole numbers: a vector's products with all
of a block are the sum of the block's counts in its few dimensions, and vectors that begin alike share the sums of what they share. So
blocks of such vectors are compared without bounds.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import dense
from tessera.plans.shared import discard, stored

#: Vectors in a block, at least and at most as planned; smaller groups have about so many blocks.
TILE, MOST, SPREAD = 2_000, 20_000, 12
#: Vectors under one bound, and bounds taken at once.
LEAF, BOUNDS = 8, 32
#: Vectors that the blocks of a group are planned on; where a vector lies changes the work and no result.
PLANNED = 8_000
#: Parts between which a matrix has the limits; for more there is one limit.
PARTS = 512
#: Edges between parts that a task holds before it keeps the lightest.
HELD = 200_000
#: Steps of a squared distance at which limits of counts are kept, and bytes of them that a task keeps.
STEPS, KEPT = 16, 32_000_000
#: What single precision may be off, as a share of the squared lengths.
SLACK = 1e-5


def coded(rows: DataFrame, group: str, key: str, source: str, encode: Callable[[list], np.ndarray]) -> DataFrame:
    """(group, key, code, vec) of ``rows(group, key, source)``; copies have the same code."""
    kinds = dict(rows.dtypes)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            if len(b):
                v = np.round(np.asarray(encode(list(b[source])), dtype=float), 12) + 0.0
                raw = [x.tobytes() for x in v]
                yield pd.DataFrame({group: b[group], key: b[key], "code": [hashlib.md5(x, usedforsecurity=False).hexdigest() for x in raw], "vec": raw})

    return rows.select(group, key, source).mapInPandas(batches, f"{group} {kinds[group]}, {key} {kinds[key]}, code string, vec binary")


def _split(v: np.ndarray, parts: int) -> tuple[int, float]:
    """Of the dimensions of most variance the one that deals the rows most evenly to ``parts`` blocks, and a value that parts the rows there."""
    found = []
    for k in np.argsort(-v.var(axis=0), kind="stable")[:16].tolist():
        x = 0.0 if 1 / 8 <= (v[:, k] > 0).mean() <= 7 / 8 else float(np.median(v[:, k]))
        share = (v[:, k] > x).mean()
        found.append((abs(share - min(max(1, round(parts * share)), parts - 1) / parts), k, x))
    return min(found)[1:]


def plan(v: np.ndarray, parts: int, first: int = 0) -> tuple:
    """A tree of splits that deals like rows to ``parts`` blocks: (dimension, value, below, above), or (first block, blocks)."""
    if parts > 1 and len(v) > 1:
        k, x = _split(v, parts)
        above = v[:, k] > x
        if 0 < above.sum() < len(v):
            low = min(max(1, round(parts * (1 - above.mean()))), parts - 1)
            return k, x, plan(v[~above], low, first), plan(v[above], parts - low, first + low)
    return first, parts


def placed(v: np.ndarray, tree: tuple, codes: np.ndarray) -> np.ndarray:
    if len(tree) == 2:
        return tree[0] + np.array([int(c[:8], 16) % tree[1] for c in codes], dtype=np.int64)
    out, above = np.zeros(len(v), np.int64), v[:, tree[0]] > tree[1]
    for own, sub in ((~above, tree[2]), (above, tree[3])):
        out[own] = placed(v[own], sub, codes[own])
    return out


def _ordered(v: np.ndarray) -> np.ndarray:
    """The rows in an order in which each ``LEAF`` of them are alike."""
    out, todo = [], [np.arange(len(v))]
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            out.append(at)
            continue
        x = v[at]
        k = int(x[:: max(1, len(x) // 4_000)].var(axis=0).argmax())
        at = at[np.argsort(-x[:, k], kind="stable")]
        n = min(max(int((x[:, k] > 0).sum()), len(at) // 8), len(at) - len(at) // 8)
        n = min(max(LEAF, round(n / LEAF) * LEAF), (len(at) - 1) // LEAF * LEAF)
        todo += [at[n:], at[:n]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _packed(v: np.ndarray) -> bytes:
    """The rows, counts as bytes and vectors as they are."""
    return zlib.compress(np.packbits(v != 0).tobytes() + v[v != 0].tobytes(), 1)


def _unpacked(data: bytes, n: int, dim: int) -> np.ndarray:
    raw, size = zlib.decompress(data), (n * dim + 7) // 8
    held = np.unpackbits(np.frombuffer(raw, np.uint8, size), count=n * dim).reshape(n, dim) > 0
    kind = np.uint8 if len(raw) - size == held.sum() else float
    out = np.zeros((n, dim), kind)
    out[held] = np.frombuffer(raw[size:], kind)
    return out


class _Block:
    """The vectors of a block with the bounds of its leaves."""

    def __init__(self, v: np.ndarray) -> None:
        self.v, self.x, self.sq = v, v.astype(np.float32), (v * v).sum(axis=1).astype(np.float32)
        self.at = np.arange(0, len(v), LEAF)
        self.top, self.low = np.maximum.reduceat(self.x, self.at), np.minimum.reduceat(self.x, self.at)
        self.least, self.most = np.minimum.reduceat(self.sq, self.at), float(self.sq.max())


class _Counted:
    """The vectors of a block as counts, in the order of ``_Block``."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts, self.lengths = counts, _lengths(counts)

    @property
    def v(self) -> np.ndarray:
        return self.counts / np.where(self.lengths > 0, self.lengths, 1.0)[:, None]


def _block(rows: np.ndarray) -> _Block | _Counted:
    return _Counted(rows) if rows.dtype == np.uint8 else _Block(rows)


def _alike(p: _Block | _Counted, q: _Block | _Counted) -> tuple:
    """Both as they are, or as vectors where one has no counts."""
    return (p, q) if type(p) is type(q) else tuple(_Block(x.v) if isinstance(x, _Counted) else x for x in (p, q))


def _near(p: _Block, q: _Block, same: bool, limit: Callable[[slice], np.ndarray]) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
    """(rows of ``p``, a leaf of ``q``, their squared distances): all rows that have a squared distance within ``limit`` of the leaf; of a block with itself the rows up to the leaf."""
    slack = np.float32(SLACK * (p.most + q.most))
    # the product of both sides is the least squared distance, less the squared length in the leaf
    side, bound = [-2 * np.maximum(p.x, 0), p.sq[:, None]], [q.top, np.ones((len(q.at), 1), np.float32)]
    if p.x.min() < 0:
        side.append(2 * np.maximum(-p.x, 0))
        bound.append(q.low)
    rows_of, leaves = np.concatenate(side, axis=1), np.concatenate(bound, axis=1)
    del side, bound
    for g in range(0, len(q.at), BOUNDS):
        n = min(len(p.x), (g + BOUNDS) * LEAF) if same else len(p.x)
        u = leaves[g : g + BOUNDS] @ rows_of[:n].T
        for r in range(len(u)):
            leaf = slice(int(q.at[g + r]), min(int(q.at[g + r]) + LEAF, len(q.x)))
            most = limit(leaf)[:n] + slack
            rows = np.flatnonzero(u[r] <= most - q.least[g + r])
            if len(rows):
                d = p.sq[rows, None] + q.sq[None, leaf] - 2 * (p.x[rows] @ q.x[leaf].T)
                near = (d <= most[rows, None]).any(axis=1)
                if near.any():
                    yield rows[near], leaf, d[near]


def _counts(v: np.ndarray) -> np.ndarray | None:
    """The whole numbers of which each row is the multiple at length one; None where a row is none, or has larger ones than a byte holds."""
    if not len(v) or v.min() < 0:
        return None
    ratio = v / np.where(v > 0, v, np.inf).min(axis=1, initial=1.0)[:, None]
    out, left = np.zeros(v.shape, np.uint8), np.arange(len(v))
    for m in range(1, 9):
        c = np.rint(ratio[left] * m)
        whole = (np.abs(c - ratio[left] * m).max(axis=1) < 1e-7) & (c.max(axis=1) < 256)
        out[left[whole]] = c[whole]
        left = left[~whole]
        if not len(left):
            norm = _lengths(out)
            return out if np.abs(out / np.where(norm > 0, norm, 1.0)[:, None] - v).max() < 1e-9 else None
    return None


def _lengths(c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", c, c, dtype=np.int64).astype(float))


def _products(p: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row of ``q``, its products with all rows of ``p``) for rows of counts; the products hold until the next."""
    kind = np.uint8 if _lengths(p).max() * _lengths(q).max() < 255 else np.uint16 if _lengths(p).max() * _lengths(q).max() < 65_535 else np.int64
    # common dimensions come first, so that like rows share sums
    place = np.argsort(-(q > 0).sum(axis=0), kind="stable")
    planes = list(np.ascontiguousarray(p[:, place].T).astype(kind, copy=False))
    rows, at = np.nonzero(q[:, place])
    times = q[rows, place[at]]
    rows, at = np.repeat(rows, times), np.repeat(at, times)
    n = np.bincount(rows, minlength=len(q))
    words = np.full((len(q), int(n.max()) + 1), -1, np.int16)
    words[rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)] = at
    order = np.lexsort(words.T[::-1])
    words, n = words[order], n[order].tolist()
    shared = [0, *np.argmax(words[1:] != words[:-1], axis=1).tolist()]
    # rows with the same counts share all
    alike = np.r_[False, (words[1:] == words[:-1]).all(axis=1)]
    sums, add = [np.zeros(len(p), kind)] + [np.empty(len(p), kind) for _ in range(words.shape[1])], np.add
    for j, m, k, same, own in zip(order.tolist(), shared, n, alike.tolist(), words.tolist(), strict=True):
        if not same:
            for x in range(m, k):
                add(sums[x], planes[own[x]], sums[x + 1])
        yield j, sums[k]


def _least(need: np.ndarray, kind: np.dtype) -> np.ndarray:
    """The least whole products that may reach ``need``."""
    return np.clip(np.ceil(need - 1e-6), 0, np.iinfo(kind).max).astype(kind)


def _needed(lengths: np.ndarray, length: float, most: np.ndarray | float) -> np.ndarray:
    """The product from which vectors of two lengths as counts are within the squared distance ``most``; at length one they have 1, without words 0."""
    # no squared distance is above 2, and an infinite one has no product with 0
    return ((lengths > 0) + float(length > 0) - np.minimum(most, 8.0)) / 2 * lengths * length if length > 0 else np.zeros(len(lengths))


def _places(hit: np.ndarray) -> np.ndarray:
    """``flatnonzero`` of a few of many, by 64 at a time."""
    if len(hit) % 64:
        return np.flatnonzero(hit)
    some = np.flatnonzero(np.packbits(hit).view(np.uint64))
    at, place = np.nonzero(hit.reshape(-1, 64)[some])
    return some[at] * 64 + place


def _counted_neighbours(p: _Counted, q: _Counted, same: bool, rp: np.ndarray, rq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``_neighbours`` has, of counts."""
    order = np.argsort(p.lengths, kind="stable")
    ordered, runs = p.lengths[order], -(-len(order) // 64) * 64
    # radii by steps, upwards: the same limits serve many rows
    steps = (np.ceil(np.minimum(rq.astype(float), 8.0) * STEPS) / STEPS).tolist()
    mine, lengths, known, own = rp[order].astype(float), q.lengths.tolist(), {}, {}
    hit, ids, found = np.zeros(runs, bool), [], []
    for j, product in _products(p.counts[order], q.counts):
        key = (lengths[j], steps[j])
        if key not in own:
            if len(own) * runs > KEPT:
                own.clear()
            if key[0] not in known:
                known[key[0]] = _least(_needed(ordered, key[0], mine), product.dtype)
            own[key] = np.minimum(known[key[0]], _least(_needed(ordered, key[0], key[1]), product.dtype))
        np.greater_equal(product, own[key], out=hit[: len(order)])
        at = _places(hit)
        ids.append((j, len(at)))
        found.append((order[at], product[at]))
    j = np.repeat([x for x, _ in ids], [n for _, n in ids]).astype(np.int64)
    i, product = (np.concatenate(x) for x in zip(*found, strict=True))
    if same:
        once = i < j
        i, j, product = i[once], j[once], product[once]
    d = _count_distances(p.lengths[i], q.lengths[j], product.astype(float))
    near = d * d <= np.maximum(rp[i], rq[j]) + SLACK
    return i[near], j[near], d[near]


def _count_distances(a: np.ndarray, b: np.ndarray | float, product: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a > 0) * 1.0 + (np.asarray(b) > 0) - 2 * product / np.maximum(a * b, 1.0), 0))


def _counted_between(p: _Counted, q: _Counted, same: bool, parts: tuple[np.ndarray, np.ndarray], cores: tuple[np.ndarray, np.ndarray], limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``_between`` has, of rows of counts: the lightest edge between each two parts that is below their limit, and of one limit all such."""
    (pp, qp), one, limits = parts, len(limits) == 1, limits.copy()
    lengths = q.lengths.tolist()
    order = np.lexsort((p.lengths, pp))
    ordered, hit = p.lengths[order], np.zeros(-(-len(order) // 64) * 64, bool)
    starts = np.searchsorted(pp[order], np.arange(max(pp.max(), qp.max()) + 2)).tolist()
    here, known = np.unique(pp), {}
    tops = {b: float(limits[0, 0] if one else limits[here, b].max()) for b in np.unique(qp).tolist()}
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    found: list[tuple] = []
    held = 0

    def lightest(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, w = (np.concatenate(x) for x in zip(*found, strict=True))
        a, b = pp[i], qp[j]
        if same:
            a, b = np.minimum(a, b), np.maximum(a, b)
        at = np.lexsort((j, i, w, b, a))
        at = at[np.r_[True, (a[at][1:] != a[at][:-1]) | (b[at][1:] != b[at][:-1])]] if len(at) else at
        if not one:
            limits[a[at], b[at]] = np.minimum(limits[a[at], b[at]], w[at])
            limits[b[at], a[at]] = limits[a[at], b[at]]
        return i[at], j[at], w[at]

    for j, product in _products(p.counts[order], q.counts):
        b = int(qp[j])
        # in a block with itself each two parts meet once
        lo, hi = (starts[b], len(order)) if same else (starts[b], starts[b + 1])
        key = (lengths[j], tops[b])
        if key not in known:
            if len(known) * len(hit) > KEPT:
                known.clear()
            known[key] = _least(_needed(ordered, key[0], key[1] * key[1]), product.dtype)
        np.greater_equal(product, known[key], out=hit[: len(order)])
        hit[lo:hi] = False
        at = _places(hit)
        if not len(at):
            continue
        i = order[at]
        w = np.maximum(np.maximum(_count_distances(p.lengths[i], lengths[j], product[at].astype(float)), cores[0][i]), cores[1][j])
        lighter = w < (limits[0, 0] if one else limits[pp[i], b])
        if lighter.any():
            found.append((i[lighter], np.full(int(lighter.sum()), j), w[lighter]))
            held += len(found[-1][0])
            if held > HELD:
                best, found, held = lightest([best, *found]), [], 0
    return lightest([best, *found])


def _distances(p: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.zeros(len(i))
    for k in range(0, len(i), 4_096):
        d = p[i[k : k + 4_096]] - q[j[k : k + 4_096]]
        out[k : k + 4_096] = np.sqrt((d * d).sum(axis=1))
    return out


def _first_radius(b: _Block, k: int) -> np.ndarray:
    """Per row the squared distance to the ``k``-th nearest of the rows about it, a bound of that of all."""
    out = np.full(len(b.x), np.inf, np.float32)
    for s in range(0, len(b.x), 256):
        rows, lo, hi = np.arange(s, min(s + 256, len(b.x))), max(0, s - 256), min(len(b.x), s + 512)
        if hi - lo > k:
            d = b.sq[rows, None] + b.sq[None, lo:hi] - 2 * (b.x[rows] @ b.x[lo:hi].T)
            d[np.arange(len(rows)), rows - lo] = np.inf
            out[rows] = np.partition(d, k - 1, axis=1)[:, k - 1] + np.float32(SLACK * 2 * b.most)
    return out


def _neighbours(p: _Block, q: _Block, same: bool, rp: np.ndarray, rq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``p``, row of ``q``, distance) of all pairs within the squared radius of either; of a block with itself each pair once."""
    p, q = _alike(p, q)
    if isinstance(p, _Counted):
        return _counted_neighbours(p, q, same, rp, rq)
    found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    slack = np.float32(SLACK * (p.most + q.most))
    for rows, leaf, d in _near(p, q, same, lambda s: np.maximum(rp, rq[s].max())):
        own, at = np.nonzero(d <= np.maximum(rp[rows, None], rq[None, leaf]) + slack)
        i, j = rows[own], leaf.start + at
        found.append((i[i < j], j[i < j]) if same else (i, j))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j, _distances(p.v, q.v, i, j)


def _ranked(i: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by row and distance, and the place of each entry among those of its row."""
    order = np.lexsort((d, i))
    i = i[order]
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
    return order, np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))


def _radius(n: int, i: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Per row the ``k``-th distance; without so many all are known, and it is infinite."""
    order, place = _ranked(i, d)
    out = np.full(n, np.inf)
    last = order[place == k - 1]
    out[i[last]] = d[last]
    return out


def _core(copies: np.ndarray, i: np.ndarray, d: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Per row the distance to its ``k``-th nearest, a vector counting as often as it has copies, itself included."""
    out = np.where(copies >= k, 0.0, np.inf)
    order, place = _ranked(i, d)
    have = copies.astype(np.int64)
    for m in range(int(place.max()) + 1 if len(place) else 0):
        at = order[place == m]
        at = at[have[i[at]] < k]
        if not len(at):
            break
        have[i[at]] += c[at]
        full = at[have[i[at]] >= k]
        out[i[full]] = d[full]
    return out


def parted(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(certain edges, part of each node, limits): edges in ascending order that are in the lightest tree of all pairs, of which only
    those of a weight above the ``radius`` of both nodes are unknown; the parts that they leave, and the least greatest weight on a way between two parts."""
    root, known, open_at, sure = list(range(n)), radius.tolist(), [False] * n, np.zeros(len(w), bool)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for e, (x, y, z) in enumerate(zip(a.tolist(), b.tolist(), w.tolist(), strict=True)):
        x, y = find(x), find(y)
        # the lightest known edge of a part is the lightest of all up to the least radius in it
        if (not open_at[x] and z <= known[x]) or (not open_at[y] and z <= known[y]):
            root[y], sure[e] = x, True
            known[x], open_at[x] = min(known[x], known[y]), open_at[x] or open_at[y]
        else:
            open_at[x] = open_at[y] = True
    names, part = np.unique(np.array([find(x) for x in range(n)], dtype=np.int64), return_inverse=True)
    k = len(names)
    left = np.flatnonzero(~sure)
    if k > PARTS:
        return sure, part, np.full((1, 1), float(w[left].max()) if len(left) == k - 1 else np.inf)
    limits, members = np.full((k, k), np.inf), {x: [x] for x in range(k)}
    of = list(range(k))
    for e in left.tolist():
        x, y = of[part[a[e]]], of[part[b[e]]]
        limits[np.ix_(members[x], members[y])] = limits[np.ix_(members[y], members[x])] = w[e]
        for m in members[y]:
            of[m] = x
        members[x] += members.pop(y)
    np.fill_diagonal(limits, -1.0)
    return sure, part, limits


def _between(p: _Block, q: _Block, same: bool, parts: tuple[np.ndarray, np.ndarray], cores: tuple[np.ndarray, np.ndarray], limits: np.ndarray, radii: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``p``, row of ``q``, weight): the lightest edge between each two parts that is below their limit. Rows are in the order of parts.

    With ``radii``, edges within the radius of an end are known and not sought.
    """
    (pp, qp), one = parts, len(limits) == 1
    # an edge is no shorter than the core distances of its ends, and one that is sought longer than their radii
    kept = []
    for mine, others, least in ((pp, qp, 0), (qp, pp, 1)):
        most = np.full(len(mine), limits[0, 0]) if one else limits[:, np.unique(others)].max(axis=1)[mine]
        kept.append(np.flatnonzero((cores if radii is None else radii)[least] < most))
    if not len(kept[0]) or not len(kept[1]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    pp, qp, cores = pp[kept[0]], qp[kept[1]], (cores[0][kept[0]], cores[1][kept[1]])
    p, q = _alike(p, q)
    if isinstance(p, _Counted):
        i, j, w = _counted_between(_Counted(p.counts[kept[0]]), _Counted(q.counts[kept[1]]), same, (pp, qp), cores, limits)
        k = forest_of(np.minimum(pp[i], qp[j]), np.maximum(pp[i], qp[j]), w)
        return kept[0][i[k]], kept[1][j[k]], w[k]
    p, q = (_Block(x.v[k]) for x, k in ((p, kept[0]), (q, kept[1])))
    top, limits = np.float32(limits.max()), limits.copy()
    c2p, c2q = (c.astype(np.float32) ** 2 for c in cores)
    slack = np.float32(SLACK * (p.most + q.most))
    out: list[tuple] = []

    def limit(leaf: slice) -> np.ndarray:
        if one:
            return np.where((pp == qp[leaf.start]) & (qp[leaf.start] == qp[leaf.stop - 1]), np.float32(-np.inf), top * top)
        few = limits[:, qp[leaf.start]] if qp[leaf.start] == qp[leaf.stop - 1] else limits[:, qp[leaf]].max(axis=1)
        most = np.where(few > 0, few * few, -np.inf).astype(np.float32)[pp]
        most[np.maximum(c2p, c2q[leaf].min()) > most + slack] = -np.inf
        return most

    for rows, leaf, d in _near(p, q, same, limit):
        for b in np.unique(qp[leaf]).tolist():
            at = np.flatnonzero(qp[leaf] == b)
            w = np.maximum(np.maximum(d[:, at], c2p[rows, None]), c2q[None, leaf][:, at])
            a = pp[rows]
            most = np.full(len(rows), top) if one else limits[a, b]
            w[a == b] = np.inf
            starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            best = np.repeat(np.minimum.reduceat(w.min(axis=1), starts), np.diff(np.r_[starts, len(a)]))
            i, j = np.nonzero(w <= (np.minimum(best, most * most) + slack)[:, None])
            if not len(i):
                continue
            a, i, j = a[i], rows[i], leaf.start + at[j]
            keep = a != b
            a, i, j = a[keep], i[keep], j[keep]
            exact = np.maximum(_distances(p.v, q.v, i, j), np.maximum(cores[0][i], cores[1][j]))
            order = np.lexsort((j, i, exact, a))
            for e in order[np.r_[True, a[order][1:] != a[order][:-1]]].tolist() if len(order) else []:
                if exact[e] < (limits[0, 0] if one else limits[a[e], b]):
                    out.append((int(i[e]), int(j[e]), float(exact[e])))
                    if not one:
                        limits[a[e], b] = limits[b, a[e]] = exact[e]
    i, j, w = (np.array(x, dtype=t) for x, t in zip(zip(*out, strict=True) if out else ((), (), ()), (np.int64, np.int64, float), strict=True))
    x, y = pp[i], qp[j]
    k = forest_of(np.minimum(x, y), np.maximum(x, y), w)
    return kept[0][i[k]], kept[1][j[k]], w[k]


def forest_of(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The edges of the lightest spanning forest, from the lightest; of equal ones that of the smaller nodes."""
    names, ab = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.lexsort((b, a, w))
    root, keep = list(range(len(names))), []
    for e, x, y in zip(order.tolist(), ab[: len(a)][order].tolist(), ab[len(a) :][order].tolist(), strict=True):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[y] = x
            keep.append(e)
    return np.array(keep, dtype=np.int64)


#: Neighbours as columns of arrays: row, the other vector, distance, copies of the other.
LISTS, LIST_TYPES, LISTS_KIND = ("near_row", "near_id", "near_d", "near_c"), (np.int64, np.int64, float, np.int64), "near_row binary, near_id binary, near_d binary, near_c binary"


def _listed(i: np.ndarray, o: np.ndarray, d: np.ndarray, c: np.ndarray) -> tuple[bytes, ...]:
    return tuple(np.asarray(x, dtype=t).tobytes() for x, t in zip((i, o, d, c), LIST_TYPES, strict=True))


def labelled(rows: DataFrame, group: str, key: str, min_size: int, tile: int = TILE) -> DataFrame:
    """(group, key, vec, cluster) of ``rows`` from ``coded``; noise is -1, clusters of a group are numbered from 0."""
    kind = dict(rows.dtypes)[group]
    rows = stored(rows)
    distinct = rows.groupBy(group, "code").agg(F.count("*").alias("copies"), F.first("vec").alias("vec"))
    n, near = F.col("n"), 2 * min_size
    sizes = distinct.groupBy(group).agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(n / F.least(F.greatest(n / SPREAD, F.lit(tile)), F.lit(max(tile, MOST)))))

    def planned(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("code")
        v = np.stack([np.frombuffer(x) for x in pdf["vec"]])
        return pd.DataFrame([(pdf[group].iat[0], int(pdf["blocks"].iat[0]), pickle.dumps(plan(v, int(pdf["blocks"].iat[0]))))], columns=[group, "blocks", "tree"])

    # codes are digests, so their order is one of chance
    some = distinct.join(sizes, group).where(F.conv(F.substring("code", 1, 8), 16, 10).cast("long") <= F.lit(2.0**32 * PLANNED) / n)
    trees = stored(some.groupBy(group).applyInPandas(planned, f"{group} {kind}, blocks long, tree binary"))

    def deal(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            if len(b):
                b = b.reset_index(drop=True)
                at = np.zeros(len(b), np.int64)
                for t, own in b.groupby("tree").indices.items():
                    at[own] = placed(np.stack([np.frombuffer(x) for x in b["vec"].iloc[own]]), pickle.loads(t), b["code"].to_numpy()[own])  # noqa: S301 - written above
                yield b.assign(block=at)[[group, "block", "blocks", "code", "copies", "vec"]]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("code").reset_index(drop=True)
        v = np.stack([np.frombuffer(x) for x in pdf["vec"]])
        order = _ordered(v.astype(np.float32))
        v, copies = v[order], pdf["copies"].to_numpy()[order]
        b = _Block(v)
        first = _first_radius(b, near)
        counts = _counts(v)
        if counts is not None:
            b = _Counted(counts)
        i, j, d = _neighbours(b, b, True, first, first)
        i, j, d = np.r_[i, j], np.r_[j, i], np.r_[d, d]
        radius = _radius(len(v), i, d, near)
        own = d <= radius[i]
        k = int(pdf["block"].iat[0])
        return pd.DataFrame(
            [(pdf[group].iat[0], k, int(pdf["blocks"].iat[0]), list(pdf["code"].to_numpy()[order]), list(map(int, copies)), v.shape[1], _packed(v if counts is None else counts), radius.tobytes(), *_listed(i[own], (k << 32) + j[own], d[own], copies[j[own]]))],
            columns=[group, "block", "blocks", "codes", "copies", "dim", "data", "radius", *LISTS],
        )

    dealt = distinct.join(F.broadcast(trees), group).mapInPandas(deal, f"{group} {kind}, block long, blocks long, code string, copies long, vec binary")
    packed = stored(dealt.groupBy(group, "block").applyInPandas(pack, f"{group} {kind}, block long, blocks long, codes array<string>, copies array<long>, dim int, data binary, radius binary, {LISTS_KIND}"))
    n_pairs = packed.agg(F.sum((F.col("blocks") + 1) / 2)).first()[0] or 1
    tasks = min(max(1, round(n_pairs)), 4_096)

    def paired(blocks: DataFrame, same: bool) -> DataFrame:
        other = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        pairs = other.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other")
        return (pairs if same else pairs.where("lo < hi")).repartition(tasks, group, "lo", "hi").groupBy(group, "lo", "hi")

    def sides(pdf: pd.DataFrame) -> list:
        rows = [r for _, r in pdf.sort_values("block").iterrows()]
        return [(r, _unpacked(r["data"], len(r["copies"]), int(r["dim"])), np.asarray(r["copies"])) for r in rows]

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        # a pair of blocks one of which is empty has nothing to compare
        if len(pdf) < 2:
            return pd.DataFrame({c: [] for c in (group, "block", *LISTS)})
        (r, v, cv), (s, w, cw) = sides(pdf)
        rv, rw = np.frombuffer(r["radius"]), np.frombuffer(s["radius"])
        i, j, d = _neighbours(_block(v), _block(w), False, (rv * rv).astype(np.float32), (rw * rw).astype(np.float32))
        x, y = d <= rv[i], d <= rw[j]
        out = [(r[group], int(r["block"]), *_listed(i[x], (int(s["block"]) << 32) + j[x], d[x], cw[j[x]])), (s[group], int(s["block"]), *_listed(j[y], (int(r["block"]) << 32) + i[y], d[y], cv[i[y]]))]
        return pd.DataFrame(out, columns=[group, "block", *LISTS])

    lists = stored(paired(packed.select(group, "block", "blocks", "copies", "dim", "data", "radius"), False).applyInPandas(nearest, f"{group} {kind}, block long, {LISTS_KIND}"))
    own = packed.select(group, "block", "copies", *LISTS).unionByName(lists.withColumn("copies", F.lit(None).cast("array<long>")))

    def least(pdf: pd.DataFrame) -> pd.DataFrame:
        copies, k = np.asarray(next(c for c in pdf["copies"] if c is not None)), int(pdf["block"].iat[0])
        i, o, d, c = (np.concatenate([np.frombuffer(x, t) for x in pdf[name]]) for name, t in zip(LISTS, LIST_TYPES, strict=True))
        radius, core = _radius(len(copies), i, d, near), _core(copies, i, d, c, min_size)
        kept = d <= radius[i]
        return pd.DataFrame([(pdf[group].iat[0], k, core.tobytes(), radius.tobytes(), ((k << 32) + i[kept]).tobytes(), o[kept].tobytes(), d[kept].tobytes())], columns=[group, "block", "core", "radius", "a", "b", "d"])

    cored = stored(own.groupBy(group, "block").applyInPandas(least, f"{group} {kind}, block long, core binary, radius binary, a binary, b binary, d binary"))

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        cores = [np.frombuffer(x) for x in pdf["core"]]
        ids = np.concatenate([(int(k) << 32) + np.arange(len(c)) for k, c in zip(pdf["block"], cores, strict=True)])
        a, b = (np.searchsorted(ids, np.concatenate([np.frombuffer(x, np.int64) for x in pdf[k]])) for k in ("a", "b"))
        core, radius = np.concatenate(cores), np.concatenate([np.frombuffer(x) for x in pdf["radius"]])
        w = np.maximum(np.concatenate([np.frombuffer(x) for x in pdf["d"]]), np.maximum(core[a], core[b]))
        a, b = np.minimum(a, b), np.maximum(a, b)
        e = forest_of(a, b, w)
        e = e[w[e] < np.inf]
        a, b, w = a[e], b[e], w[e]
        sure, parts, limits = parted(len(ids), a, b, w, radius)
        ends, at = np.cumsum([len(c) for c in cores]), 0
        out = []
        for k, end in zip(pdf["block"], ends.tolist(), strict=True):
            edges = [x.tobytes() for x in (ids[a], ids[b], w)] if at == 0 else [b""] * 3  # once a group
            out.append((pdf[group].iat[0], int(k), parts[at:end].astype(np.int64).tobytes(), zlib.compress(limits.tobytes(), 1), int(parts.max()) + 1, *edges))
            at = end
        return pd.DataFrame(out, columns=[group, "block", "part", "limits", "parts", "a", "b", "w"])

    split = stored(cored.groupBy(group).applyInPandas(part, f"{group} {kind}, block long, part binary, limits binary, parts long, a binary, b binary, w binary"))
    discard(lists)

    def lightest(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = [group, "a", "b", "w"]
        same = pdf["lo"].iat[0] == pdf["hi"].iat[0]
        if not same and len(pdf) < 2:
            return pd.DataFrame({c: [] for c in columns})
        found = []
        for r, v, _ in sides(pdf):
            parts = np.frombuffer(r["part"], np.int64)
            order = np.argsort(parts, kind="stable")
            found.append((int(r["block"]) << 32, order, _block(v[order]), parts[order], np.frombuffer(r["core"])[order], np.frombuffer(r["radius"])[order]))
        (x, xo, p, pp, pc, pr), (y, yo, q, qp, qc, qr) = found[0], found[-1]
        limits = np.frombuffer(zlib.decompress(pdf["limits"].iat[0]))
        i, j, w = _between(p, q, same, (pp, qp), (pc, qc), limits.reshape(round(len(limits) ** 0.5), -1), (pr, qr))
        a, b = x + xo[i], y + yo[j]
        return pd.DataFrame([(pdf[group].iat[0], np.minimum(a, b).tobytes(), np.maximum(a, b).tobytes(), w.tobytes())], columns=columns)

    blocks = packed.select(group, "block", "blocks", "copies", "dim", "data").join(split.where("parts > 1").select(group, "block", "part", "limits"), [group, "block"]).join(cored.select(group, "block", "core", "radius"), [group, "block"])
    edges = paired(blocks, True).applyInPandas(lightest, f"{group} {kind}, a binary, b binary, w binary").unionByName(split.select(group, "a", "b", "w"))

    def tree(blocks: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block")
        ids = np.concatenate([(int(k) << 32) + np.arange(len(c)) for k, c in zip(blocks["block"], blocks["copies"], strict=True)])
        a, b = (np.searchsorted(ids, np.concatenate([np.frombuffer(x, np.int64) for x in pairs[k]])) for k in ("a", "b"))
        w = np.concatenate([np.frombuffer(x) for x in pairs["w"]])
        e = forest_of(a, b, w)
        core, copies = np.concatenate([np.frombuffer(x) for x in blocks["core"]]), np.concatenate([np.asarray(x) for x in blocks["copies"]])
        labels = dense.tree_labels(list(zip(w[e].tolist(), a[e].tolist(), b[e].tolist(), strict=True)), core, min_size, copies)
        return pd.DataFrame({group: blocks[group].iat[0], "code": np.concatenate([np.asarray(x, dtype=object) for x in blocks["codes"]]), "cluster": labels})

    whole = packed.select(group, "block", "codes", "copies").join(cored.select(group, "block", "core"), [group, "block"])
    named = whole.groupBy(group).cogroup(edges.groupBy(group)).applyInPandas(tree, f"{group} {kind}, code string, cluster int")
    return rows.join(named, [group, "code"]).select(group, key, "vec", "cluster")
