"""Evidence that no hypothesis explains: residual scores, coherent clusters, proposed hypotheses and their check."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.vectors import hash_matrix
from tessera.operators import dense, density
from tessera.operators.ranking import first_k, ranked
from tessera.plans.settings import DEFAULTS, PROPOSAL, Settings
from tessera.plans.shared import stored


#: Hypotheses that a task holds at a time as dense rows of 256 numbers: 8 MB.
SIDE_ROWS = 4_096


def residual_scores(cells: DataFrame) -> DataFrame:
    """Per data point and model, the greatest absolute log lift of any hypothesis; 0 without cells."""
    return cells.groupBy("dp_id", "model").agg(F.coalesce(F.max(F.abs("log_lift")), F.lit(0.0)).alias("residual"), F.count("*").alias("n_hyps"))


def residuals(cells: DataFrame, epsilon: float = DEFAULTS.residual_epsilon) -> DataFrame:
    return residual_scores(cells).where(F.col("residual") <= epsilon)


def clusters(rows: DataFrame, group: str, settings: Settings = DEFAULTS, encode: Callable[[list[str]], np.ndarray] = hash_matrix, whole_below: int = 2_000) -> DataFrame:
    """(group, cluster, dp_ids, size, coherence) of ``rows(group, dp_id, text)``, clustered within each group.

    Small groups are merged bottom-up by average cosine distance, larger ones by density. Both need all distances: a group
    of more than ``whole_below`` rows has them by pairs of blocks (``density``). Only the order of equal distances is open there, as it is in one task.
    """
    kind = dict(rows.dtypes)[group]
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    tagged = rows.join(sizes, group)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dp_id")
        empty = pd.DataFrame(columns=[group, "cluster", "dp_ids", "size", "coherence"], dtype=object)
        if len(pdf) < settings.min_cluster:
            return empty
        v = encode(list(pdf["text"]))
        labels = dense.average_linkage(v, settings.cluster_distance) if len(pdf) < settings.dense_below else dense.hdbscan(v, settings.min_cluster)
        ids, out = pdf["dp_id"].to_numpy(), []
        for c in sorted(set(labels) - {-1}):
            own = labels == c
            if own.sum() >= settings.min_cluster:
                out.append((pdf[group].iat[0], sorted(map(str, ids[own])), int(own.sum()), dense.coherence(v[own])))
        out.sort(key=lambda x: (-round(x[3], 9), x[1]))
        return pd.DataFrame([(g, k, d, n, c) for k, (g, d, n, c) in enumerate(out)], columns=list(empty.columns)) if out else empty

    schema = f"{group} {kind}, cluster int, dp_ids array<string>, size int, coherence double"
    small = tagged.where(F.col("_n") <= whole_below).select(group, "dp_id", "text").groupBy(group).applyInPandas(one, schema)
    if sizes.where(F.col("_n") > whole_below).isEmpty():
        return small

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(g, c, list(x["dp_id"]), np.sum([np.frombuffer(v) for v in x["vec"]], axis=0).tolist()) for (g, c), x in b.groupby([group, "cluster"])]
            yield pd.DataFrame(out, columns=[group, "cluster", "dp_ids", "s"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, x in pdf.groupby("cluster"):
            ids, s = sorted(y for d in x["dp_ids"] for y in d), np.sum([np.asarray(y) for y in x["s"]], axis=0)
            n = len(ids)
            out.append((pdf[group].iat[0], ids, n, (float((s * s).sum()) - n) / max(n * (n - 1), 1)))
        return pd.DataFrame(out, columns=[group, "dp_ids", "size", "coherence"])

    codes = density.coded(tagged.where(F.col("_n") > whole_below), group, "dp_id", "text", encode)
    members = density.labelled(codes, group, "dp_id", settings.min_cluster).where("cluster >= 0").select(group, "cluster", "dp_id", "vec")
    parts = members.mapInPandas(sums, f"{group} {kind}, cluster int, dp_ids array<string>, s array<double>")
    # a call for each cluster would cost more than its sum
    found = parts.groupBy(group, F.floor(F.col("cluster") / 64).alias("slot")).applyInPandas(total, f"{group} {kind}, dp_ids array<string>, size int, coherence double")
    numbered = ranked(stored(found), [group], [F.desc(F.round("coherence", 9)), F.asc(F.element_at("dp_ids", 1))])
    return small.unionByName(numbered.select(group, (F.col("rank") - 1).cast("int").alias("cluster"), "dp_ids", "size", "coherence"))


def top_terms(rows: DataFrame, keys: list[str], k: int = 4) -> DataFrame:
    """(keys, terms): the ``k`` words that most members have; ties in alphabetical order. Words of members only, no prompt words."""
    words = rows.select(*keys, F.explode(text.oracle_tokens("text")).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("df"))
    first = first_k(words, keys, [F.desc("df"), F.asc("term")], k)
    return first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("terms"))


def abduced(terms: DataFrame) -> DataFrame:
    """The lexical oracle's proposal for a cluster's terms."""
    return terms.withColumn("hypothesis", F.concat(F.lit(PROPOSAL[0]), F.col("terms"), F.lit(PROPOSAL[1])))


def verified(members: DataFrame, keys: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """(keys, n_members, explained, admitted) of ``members(keys, lift)``: the share that the proposal makes clearly likelier.

    A member without a lift counts as not explained.
    """
    share = F.avg(F.when(F.col("lift") >= settings.support_lift, 1.0).otherwise(0.0))
    out = members.groupBy(*keys).agg(F.count("*").alias("n_members"), share.alias("share"))
    return out.select(*keys, "n_members", F.round("share", 6).alias("explained"), (F.col("share") >= settings.admit_share).alias("admitted"))


def retrieval_baseline(hyps: DataFrame, points: DataFrame, dim: int = 256) -> DataFrame:
    """(dp_id, sim, rank): data points by their greatest cosine with any hypothesis, the first third (three at least).

    The distinct hypotheses go to the tasks as matrices of ``SIDE_ROWS`` rows at most; data points stream past each.
    """
    spark = points.sparkSession
    texts = hyps.where("text is not null").select("text").dropDuplicates()
    blocks: list[Broadcast] = []
    held: list[str] = []
    for r in texts.toLocalIterator():
        held.append(r.text)
        if len(held) == SIDE_ROWS:
            blocks.append(spark.sparkContext.broadcast(hash_matrix(held, dim)))
            held = []
    blocks.append(spark.sparkContext.broadcast(hash_matrix(held, dim)))

    def best_of(side: Broadcast) -> DataFrame:
        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                sim = (hash_matrix(list(b["text"]), dim) @ side.value.T).max(axis=1) if len(side.value) else np.zeros(len(b))
                yield pd.DataFrame({"dp_id": b["dp_id"], "sim": np.round(sim, 6)})

        return points.select("dp_id", "text").mapInPandas(best, "dp_id string, sim double")

    each = [best_of(side) for side in blocks]
    whole = each[0]
    for e in each[1:]:
        whole = whole.unionByName(e)
    scored = stored(whole.groupBy("dp_id").agg(F.max("sim").alias("sim")) if len(each) > 1 else whole)
    n = scored.count()
    k = min(n, max(3, n // 3))
    # k grows with the data, so rows are ranked by ranges and never gathered
    return ranked(scored, [], [F.desc("sim"), F.asc("dp_id")]).where(F.col("rank") <= k).drop("rank")
