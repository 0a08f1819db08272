"""Clustering and similarity of vectors that fit one task, and linear-time statistics of all pairs of many vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coherence(v: np.ndarray) -> float:
    """The mean cosine of all ordered pairs of unit vectors, from their sum: no pair is formed."""
    n = len(v)
    return (float((v.sum(axis=0) ** 2).sum()) - n) / max(n * (n - 1), 1)


def cosine_distances(v: np.ndarray) -> np.ndarray:
    """1 - cosine; a zero vector is at distance 1 from all others."""
    d = 1.0 - v @ v.T
    np.fill_diagonal(d, 0.0)
    return np.clip(d, 0.0, 2.0)


def average_linkage(v: np.ndarray, threshold: float) -> np.ndarray:
    """Labels of bottom-up clusters by average cosine distance; pairs at or beyond the threshold are not merged."""
    n = len(v)
    labels = np.arange(n)
    if n < 2:
        return labels
    d = cosine_distances(v)
    np.fill_diagonal(d, np.inf)
    size = np.ones(n)
    while True:
        i, j = sorted(np.unravel_index(int(d.argmin()), d.shape))
        if not d[i, j] < threshold:
            break
        mean = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = mean, mean
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        labels[labels == j] = i
    return np.unique(labels, return_inverse=True)[1]


def hdbscan(v: np.ndarray, min_size: int) -> np.ndarray:
    """Density clusters by excess of mass over the hierarchy of mutual reachability (Euclidean), noise as -1.

    A point's core distance is to its ``min_size``-th neighbour, itself included; the root is no cluster.
    """
    n = len(v)
    if n < max(2, min_size):
        return np.full(n, -1)
    sq = (v * v).sum(axis=1)
    dist = np.sqrt(np.maximum(sq[:, None] + sq[None] - 2 * v @ v.T, 0))
    core = np.sort(dist, axis=1)[:, min(min_size, n) - 1]
    reach = np.maximum(dist, np.maximum(core[:, None], core[None]))
    # Prim's tree, then merges in order of length
    inside, near, parent = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    edges, at = [], 0
    for _ in range(n - 1):
        inside[at] = True
        closer = (reach[at] < near) & ~inside
        near[closer], parent[closer] = reach[at][closer], at
        nxt = int(np.where(inside, np.inf, near).argmin())
        edges.append((float(near[nxt]), int(parent[nxt]), nxt))
        at = nxt
    return tree_labels(edges, core, min_size)


def tree_labels(edges: list[tuple[float, int, int]], core: np.ndarray, min_size: int, copies: np.ndarray | None = None) -> np.ndarray:
    """Labels of the density clusters of a lightest spanning tree of mutual reachabilities; points may stand for several copies."""
    n = len(core)
    weight = [1] * n if copies is None else [int(c) for c in copies]
    root, node, left, right, height, size = list(range(n)), list(range(n)), {}, {}, {}, dict(enumerate(weight))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    new = n
    for w, a, b in sorted(edges):
        x, y = find(a), find(b)
        left[new], right[new], height[new] = node[x], node[y], w
        size[new] = size[node[x]] + size[node[y]]
        root[y], node[x] = x, new
        new += 1
    density = lambda h: 1.0 / h if h > 0 else 1e12
    # condense: a split is real when both sides have min_size points, else the cluster loses points
    parent_of: dict[int, int] = {}
    born: dict[int, float] = {0: 0.0}
    falls: list[tuple[int, int, float]] = []  # cluster, point, density at which it leaves
    children: dict[int, list[int]] = {0: []}
    todo, names = [(new - 1, 0)], 1

    def points(t: int) -> list[int]:
        out, stack = [], [t]
        while stack:
            s = stack.pop()
            if s < n:
                out.append(s)
            else:
                stack += [left[s], right[s]]
        return out

    mass: dict[int, float] = {0: 0.0}
    while todo:
        t, c = todo.pop()
        if t < n:
            falls.append((c, t, density(core[t])))
            continue
        lam, sides = density(height[t]), (left[t], right[t])
        big = [s for s in sides if size[s] >= min_size]
        if len(big) == 2:
            for s in sides:
                mass[c] += size[s] * (lam - born[c])
                parent_of[names], born[names], mass[names], children[names] = c, lam, 0.0, []
                children[c].append(names)
                todo.append((s, names))
                names += 1
        else:
            for s in sides:
                if s in big:
                    todo.append((s, c))
                else:
                    for p in points(s):
                        falls.append((c, p, lam))
    for c, p, lam in falls:
        mass[c] += weight[p] * (lam - born[c])
    chosen: dict[int, bool] = {}
    best: dict[int, float] = {}
    for c in sorted(mass, reverse=True):
        below = sum(best[k] for k in children[c])
        chosen[c] = c != 0 and mass[c] >= below
        best[c] = mass[c] if chosen[c] else below
    labels = np.full(n, -1)
    numbers: dict[int, int] = {}
    tops: dict[int, int] = {0: -1}
    for k in range(1, names):
        up = tops[parent_of[k]]
        tops[k] = up if up >= 0 else k if chosen[k] else -1
    for c, p, _ in falls:
        if tops[c] >= 0:
            labels[p] = numbers.setdefault(tops[c], len(numbers))
    return labels


def pair_statistics(vectors: DataFrame, label: str, vec: str) -> DataFrame:
    """Per label p against the rest q: means and population variances of the distances 1 - cos within p, across, and within q.

    Sums over pairs come from sums over vectors: the cosines of all pairs sum to the square of the vector sum, and their squares to
    the square of the second-moment matrix. So the cost is linear, and a partition sends on one matrix per label.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[object, list] = {}
        for b in batches:
            for lab, rows in b.groupby("label", dropna=True):
                x = np.stack([np.asarray(r, dtype=float) for r in rows["vec"]])
                s = sums.setdefault(lab, [0, 0.0, 0.0, 0.0, 0.0])
                sq = (x * x).sum(axis=1)
                s[0] += len(x)
                s[1] = s[1] + x.sum(axis=0)
                s[2] = s[2] + x.T @ x
                s[3] += float(sq.sum())
                s[4] += float((sq * sq).sum())
        yield pd.DataFrame([(lab, int(n), list(map(float, s)), m.ravel().tolist(), a, c) for lab, (n, s, m, a, c) in sums.items()], columns=["label", "n", "s", "m", "a", "c"])

    kind = dict(vectors.dtypes)[label]
    parts = vectors.where(F.col(label).isNotNull() & F.col(vec).isNotNull()).select(F.col(label).alias("label"), F.col(vec).alias("vec"))
    sums = parts.mapInPandas(partial, f"label {kind}, n long, s array<double>, m array<double>, a double, c double")

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for lab, rows in pdf.groupby("label"):
            out.append((lab, int(rows["n"].sum()), np.sum([np.asarray(x) for x in rows["s"]], axis=0), np.sum([np.asarray(x) for x in rows["m"]], axis=0), float(rows["a"].sum()), float(rows["c"].sum())))
        result = []
        for lab, n, s, m, a, c in sorted(out, key=lambda r: r[0]):
            rest = [r for r in out if r[0] != lab]
            nq, sq, mq, aq, cq = (sum((r[k] for r in rest), 0) for k in (1, 2, 3, 4, 5))

            def within(k: int, v: np.ndarray, mm: np.ndarray, one: float, two: float) -> tuple[int, float, float]:
                pairs = k * (k - 1) // 2
                if not pairs:
                    return 0, float("nan"), float("nan")
                mean = (float(np.dot(v, v)) - one) / 2 / pairs
                return pairs, mean, max(0.0, (float((mm * mm).sum()) - two) / 2 / pairs - mean * mean)

            pp = within(n, s, m, a, c)
            qq = within(nq, sq, mq, aq, cq) if nq else (0, float("nan"), float("nan"))
            npq = n * nq
            mean = float(np.dot(s, sq)) / npq if npq else float("nan")
            var = max(0.0, float((m * mq).sum()) / npq - mean * mean) if npq else float("nan")
            spread = np.sqrt((pp[2] + var) / 2)
            effect = (pp[1] - mean) / spread if spread > 0 else 0.0
            result.append((lab, n, 1 - pp[1], 1 - mean, 1 - qq[1], pp[2], var, effect))
        return pd.DataFrame(result, columns=["label", "n", "mean_pp", "mean_pq", "mean_qq", "var_pp", "var_pq", "cohen_d"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        s, m = (np.sum([np.asarray(x) for x in pdf[k]], axis=0) for k in ("s", "m"))
        return pd.DataFrame([(first["label"], int(pdf["n"].sum()), list(map(float, s)), list(map(float, m)), float(pdf["a"].sum()), float(pdf["c"].sum()))], columns=["label", "n", "s", "m", "a", "c"])

    # sums run in a tree; what meets at its root is bounded by the labels, not by vectors or partitions
    sums = sums.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("label", "slot").applyInPandas(added, f"label {kind}, n long, s array<double>, m array<double>, a double, c double")
    stats = sums.withColumn("root", F.lit("root")).groupBy("root").applyInPandas(total, f"label {kind}, n long, mean_pp double, mean_pq double, mean_qq double, var_pp double, var_pq double, cohen_d double")
    word = F.when(F.col("cohen_d") < 0.2, "none").when(F.col("cohen_d") < 0.8, "weak").otherwise("strong")
    rounded = [F.round(c, 6).alias(c) for c in ("mean_pp", "mean_pq", "mean_qq", "var_pp", "var_pq")]
    return stats.select("label", "n", *rounded, F.round("cohen_d", 4).alias("cohen_d"), word.alias("separation"))


def sum_coherence(vectors: DataFrame, label: str, vec: str) -> DataFrame:
    """(label, n, coherence) in column functions: the square of the vector sum, less the pairs of a vector with itself."""
    parts = vectors.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.posexplode(vec).alias("at", "x"))
    sums = parts.groupBy("label", "at").agg(F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("own"), F.count("*").alias("n"))
    out = sums.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("all"), F.sum("own").alias("own"), F.max("n").alias("n"))
    return out.select("label", "n", F.round((F.col("all") - F.col("own")) / F.greatest(F.col("n") * (F.col("n") - 1), F.lit(1)), 6).alias("coherence"))
