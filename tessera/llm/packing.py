"""Documents packed into containers of fixed capacity, with a certificate of how near to the optimum the count is.

Items are spread over partitions of bounded size and packed best-fit decreasing in each. Dual feasible functions
give every partition a lower bound of its bins; a partition that meets its bound is certified optimal and closed.
The others put the contents of their bins that are not full into an exchange, where they meet those of other partitions and are
packed again, over fewer partitions each round, until no bin is saved. The same bounds over the histogram of all
sizes (at most ``capacity`` rows) certify the whole.

Defined results for odd input: a null text has no tokens and takes no room; a null id is no item; repeated rows of an
id are one item (the largest); an item larger than the container is cut into parts of its capacity and a rest; a
capacity that is null or below 1 is skipped; empty tables give no bins; further columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tokens import TOKENIZER_DIR, token_sizes
from tessera.plans.shared import stored, table

#: Items a partition packs at once.
PARTITION_ITEMS = 50_000


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: in order of falling size, the fullest bin that still has room."""
    bins = np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # rooms that some bin has, ascending
    n = 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        k = bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                del rooms[k]
        else:
            room, b = capacity, n
            n += 1
        bins[i] = b
        room -= size
        if not by_room[room]:
            insort(rooms, room)
        by_room[room].append(b)
    return bins


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """The best bound on the number of bins from two families of dual feasible functions.

    A function f with f(x1) + ... + f(xn) <= 1 whenever x1 + ... + xn <= capacity bounds the bins by the sum of f
    over all items. For k = 1, 2, ...: f(x) = x where (k + 1) x is a multiple of the capacity, else
    floor((k + 1) x / capacity) / k. For a threshold t <= capacity / 2: 1 above capacity - t, 0 below t, else x.
    """
    if not len(sizes):
        return 0
    x, n = sizes.astype(np.int64), counts.astype(np.int64)
    best = -(-int((x * n).sum()) // capacity)
    for k in range(1, 21):
        whole, rest = np.divmod((k + 1) * x, capacity)
        scaled = np.where(rest == 0, k * x, whole * capacity)  # times k * capacity
        best = max(best, -(-int((scaled * n).sum()) // (k * capacity)))
    order = np.argsort(x)
    xs, ns = x[order], n[order]
    mass, heads = np.concatenate([[0], np.cumsum(xs * ns)]), np.concatenate([[0], np.cumsum(ns)])
    for t in np.unique(xs[2 * xs <= capacity]):
        lo, hi = np.searchsorted(xs, t), np.searchsorted(xs, capacity - t, side="right")
        hi = max(hi, lo)
        best = max(best, int(heads[-1] - heads[hi]) - (-int(mass[hi] - mass[lo]) // capacity))
    return best


def _packed(capacity_of: dict[str, int]) -> object:
    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = capacity_of[pdf["container"].iat[0]]
        sizes = pdf["tokens"].to_numpy()
        bins = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(bins, weights=sizes)
        values, counts = np.unique(sizes, return_counts=True)
        gap = len(fill) - lower_bound(values, counts, capacity)
        return pdf.assign(bin=bins, fill=fill[bins].astype(np.int64), gap=gap)

    return group


_PACKED = "container string, part long, doc_id long, part_no int, tokens long, bin long, fill long, gap long"


def _pack(items: DataFrame, capacity_of: dict[str, int], salt: int) -> DataFrame:
    """Items (container, doc_id, part_no, tokens) packed in partitions of about ``PARTITION_ITEMS``."""
    n = items.count()
    parts = max(1, -(-n // (PARTITION_ITEMS * max(1, len(capacity_of)))))
    placed = items.withColumn("part", F.pmod(F.xxhash64("doc_id", "part_no", F.lit(salt)), F.lit(parts)))
    return stored(placed.groupBy("container", "part").applyInPandas(_packed(capacity_of), _PACKED))


def _bins(packed: DataFrame) -> int:
    return packed.select("container", "part", "bin").distinct().count()


def packings(sizes: DataFrame, capacity_of: dict[str, int]) -> DataFrame:
    """(container, round, part, bin, doc_id, part_no, tokens): every item of ``sizes(doc_id, tokens)`` in a bin of each container.

    ``round`` and ``part`` and ``bin`` together name a bin.
    """
    spark = sizes.sparkSession
    if not capacity_of:
        return spark.createDataFrame([], "container string, round int, part long, bin long, doc_id long, part_no int, tokens long")
    items: DataFrame | None = None
    for container, capacity in capacity_of.items():
        parts = F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)).cast("int")
        cut = sizes.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part_no"))
        own = cut.select(F.lit(container).alias("container"), "doc_id", F.col("part_no").cast("int"), F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("part_no") * capacity).alias("tokens"))
        items = own if items is None else items.unionByName(own)
    assert items is not None
    packed = _pack(items, capacity_of, 0)
    room = F.create_map(*[F.lit(v) for kv in capacity_of.items() for v in kv])[F.col("container")]
    closed: list[DataFrame] = []
    columns = ["container", "round", "part", "bin", "doc_id", "part_no", "tokens"]
    r = 0
    while True:  # every round saves a bin at least
        r += 1
        open_bins = (F.col("gap") > 0) & (F.col("fill") < room)
        loose = packed.where(open_bins)
        before = _bins(loose)
        if before < 2:
            break
        again = _pack(loose.select("container", "doc_id", "part_no", "tokens"), capacity_of, r)
        if _bins(again) >= before:
            break
        closed.append(packed.where(~open_bins).withColumn("round", F.lit(r - 1)).select(columns))
        packed = again
    closed.append(packed.withColumn("round", F.lit(len(closed))).select(columns))
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    return out


def capacities(packs: DataFrame) -> dict[str, int]:
    """Container to capacity; the table is fixed and small."""
    rows = packs.where("container is not null and capacity_tokens >= 1").groupBy("container").agg(F.min("capacity_tokens").alias("c")).collect()
    return {r.container: int(r.c) for r in sorted(rows)}


def document_sizes(documents: DataFrame, folder: str = TOKENIZER_DIR) -> DataFrame:
    sized = token_sizes(documents.where("doc_id is not null"), folder=folder)
    return stored(sized.groupBy("doc_id").agg(F.max("tokens").alias("tokens")))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document (or part of one too large) in a container of each capacity."""
    packed = packings(document_sizes(table(spark, sf_dir, "documents")), capacities(table(spark, sf_dir, "pack_capacity")))
    return packed.select("container", F.concat_ws("-", "container", "round", "part", "bin").alias("bin_id"), "doc_id", "part_no", "tokens")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per container: bins used, the certified lower bound, and the share of space filled."""
    capacity_of = capacities(table(spark, sf_dir, "pack_capacity"))
    packed = packings(document_sizes(table(spark, sf_dir, "documents")), capacity_of)
    sizes = packed.groupBy("container", "tokens").agg(F.count("*").alias("n"))

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf["container"].iat[0]
        return pd.DataFrame({"container": [c], "lower_bound": [lower_bound(pdf["tokens"].to_numpy(), pdf["n"].to_numpy(), capacity_of[c])]})

    bounds = sizes.groupBy("container").applyInPandas(bound, "container string, lower_bound long")
    used = packed.groupBy("container", "round", "part", "bin").agg(F.sum("tokens").alias("fill")).groupBy("container").agg(F.count("*").alias("n_bins"), F.sum("fill").alias("tokens"))
    rows = spark.createDataFrame([(c, v) for c, v in capacity_of.items()], "container string, capacity long")
    return used.join(bounds, "container").join(rows, "container").select("container", "capacity", "n_bins", "lower_bound", "tokens", (F.col("tokens") / (F.col("n_bins") * F.col("capacity"))).alias("filled"))


QUERIES = {"p8_packed": p8_packed, "p8_report": p8_report}
SQL: dict[str, str] = {}
