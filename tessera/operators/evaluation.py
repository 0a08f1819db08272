"""Measures against planted truth: scenario metrics, recall of refuting sets and clusters, reports, threshold sweeps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import dense


def ladder(low: float, high: float, steps: int = 15, margin: float = 0.03) -> list[float]:
    """Evenly spaced thresholds over a range widened by a margin, to four places."""
    lo, hi = low - margin, high + margin
    return [round(lo + (hi - lo) * k / (steps - 1), 4) for k in range(steps)]


def scenario_metrics(claims: DataFrame, points: DataFrame) -> DataFrame:
    """(scenario, m1, m2, m3) of ``claims(scenario, pos, score, surviving, eliminated)`` and ``points(scenario, diagnosticity, noise)``.

    m1: the surviving claim is not ranked last; m2: the share of eliminated claims below the mean score; m3: irrelevant
    noise is no more diagnostic on average than the rest. Each is null where it does not apply; equal scores rank by position.
    """
    last = Window.partitionBy("scenario").orderBy(F.desc("score"), "pos")
    ranked = claims.withColumn("rank", F.row_number().over(last)).withColumn("n", F.count("*").over(Window.partitionBy("scenario"))).withColumn("mean", F.avg("score").over(Window.partitionBy("scenario")))
    m1 = F.min(F.when(F.col("surviving"), F.when(F.col("rank") == F.col("n"), 0.0).otherwise(1.0)))
    m2 = F.avg(F.when(F.col("eliminated"), F.when(F.col("score") < F.col("mean"), 1.0).otherwise(0.0)))
    first = ranked.groupBy("scenario").agg(m1.alias("m1"), m2.alias("m2"))
    off_topic = F.col("noise").eqNullSafe("irrelevant")
    means = points.groupBy("scenario").agg(F.avg(F.when(off_topic, F.col("diagnosticity"))).alias("noise"), F.avg(F.when(~off_topic, F.col("diagnosticity"))).alias("real"))
    m3 = F.when(F.col("noise").isNotNull() & F.col("real").isNotNull(), F.when(F.col("noise") <= F.col("real"), 1.0).otherwise(0.0))
    return first.join(means.select("scenario", m3.alias("m3")), "scenario", "left").select("scenario", "m1", "m2", "m3")


def set_recall(planted: DataFrame, found: DataFrame) -> DataFrame:
    """(case_id, n_planted, n_hit, recall): a planted set counts when a found set of its case contains it."""
    pairs = planted.select("case_id", F.col("members").alias("p"), F.monotonically_increasing_id().alias("k")).join(found.select("case_id", F.col("members").alias("f")), "case_id", "left")
    held = F.coalesce(F.max((F.size(F.array_except("p", "f")) == 0).cast("int")), F.lit(0))
    hits = pairs.groupBy("case_id", "k").agg(held.alias("hit"))
    return hits.groupBy("case_id").agg(F.count("*").alias("n_planted"), F.sum("hit").alias("n_hit"), F.round(F.avg("hit"), 6).alias("recall"))


def cluster_recall(planted: DataFrame, found: DataFrame) -> DataFrame:
    """(case_id, recall, purity): of the found cluster with the greatest recall, the first on ties; zeros without one."""
    pairs = planted.select("case_id", F.col("members").alias("p")).join(found.select("case_id", "pos", F.col("members").alias("f")), "case_id", "left")
    both = F.size(F.array_intersect("p", F.coalesce("f", F.array().cast("array<string>"))))
    scored = pairs.select("case_id", "pos", (both / F.greatest(F.size("p"), F.lit(1))).alias("recall"), F.coalesce(both / F.greatest(F.size("f"), F.lit(1)), F.lit(0.0)).alias("purity"))
    best = scored.groupBy("case_id").agg(F.min_by(F.struct("recall", "purity"), F.struct((-F.col("recall")).alias("r"), F.col("pos"))).alias("x"))
    return best.select("case_id", F.round("x.recall", 6).alias("recall"), F.round("x.purity", 6).alias("purity"))


def member_recall(planted: DataFrame, found: DataFrame) -> DataFrame:
    """(case_id, recall): the share of the members of all planted sets of a case that a baseline found; of ``planted(case_id, members)`` and ``found(case_id, dp_id)``."""
    members = planted.select("case_id", F.explode("members").alias("dp_id")).dropDuplicates()
    hit = members.join(found.select("case_id", "dp_id", F.lit(1).alias("hit")).dropDuplicates(), ["case_id", "dp_id"], "left")
    return hit.groupBy("case_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


def control_findings(cases: DataFrame, found: DataFrame) -> DataFrame:
    """(case_id, n_found, clean) of the control cases: whatever is found in one is false. ``found(case_id)``, a row a set or admitted hypothesis."""
    n = found.groupBy("case_id").agg(F.count("*").alias("n"))
    rows = cases.where("control").select("case_id").dropDuplicates().join(n, "case_id", "left").select("case_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_found"))
    return rows.withColumn("clean", F.col("n_found") == 0)


def conjunction_found(found: DataFrame) -> DataFrame:
    """(case_id, conjunction_only): whether any set found in a case refutes only as a whole."""
    return found.groupBy("case_id").agg(F.coalesce(F.bool_or("conjunction_only"), F.lit(False)).alias("conjunction_only"))


def report(cases: DataFrame, measures: list[str]) -> DataFrame:
    """Means of measures over main, adversarial and control cases apart; absent values are passed over."""
    group = F.when(F.col("control"), "control").when(F.col("adversarial").isNotNull(), "adversarial").otherwise("main")
    return cases.groupBy("capability", group.alias("case_group")).agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in measures])


def threshold_sweep(rows: DataFrame, group: str, thresholds: list[float], min_sizes: list[int]) -> DataFrame:
    """(group, threshold, min_size, n_clusters, recall, purity, f1) of ``rows(group, dp_id, vec, planted)``: average linkage at every grid point.

    The best F1 of a cluster against the planted members; a group is one case and fits a task.
    """
    kind = dict(rows.dtypes)[group]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dp_id")
        v, planted = np.stack([np.asarray(x, dtype=float) for x in pdf["vec"]]), pdf["planted"].to_numpy(bool)
        out = []
        for t in thresholds:
            labels = dense.average_linkage(v, t)
            for least in min_sizes:
                best, n = (0.0, 0.0, 0.0), 0
                for c in set(labels):
                    own = labels == c
                    if own.sum() >= least:
                        n += 1
                        hit = float((own & planted).sum())
                        recall, purity = hit / max(planted.sum(), 1), hit / own.sum()
                        best = max(best, (2 * recall * purity / (recall + purity) if hit else 0.0, recall, purity))
                f1, recall, purity = best
                out.append((pdf[group].iat[0], t, least, n, round(recall, 6), round(purity, 6), round(f1, 6)))
        return pd.DataFrame(out, columns=[group, "threshold", "min_size", "n_clusters", "recall", "purity", "f1"])

    return rows.groupBy(group).applyInPandas(one, f"{group} {kind}, threshold double, min_size int, n_clusters int, recall double, purity double, f1 double")


def best_threshold(sweep: DataFrame, group: str) -> DataFrame:
    """The grid point of the greatest F1 of each group, the first on ties."""
    first = F.struct((-F.col("f1")).alias("f"), "min_size", "threshold")
    return sweep.groupBy(group).agg(F.min_by(F.struct("threshold", "min_size", "f1"), first).alias("x")).select(group, "x.threshold", "x.min_size", "x.f1")
