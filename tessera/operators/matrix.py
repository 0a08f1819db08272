"""Answers over the grid of cells: scores, verdicts, best and worst evidence, diagnosticity, detail and wide views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scale, text
from tessera.operators.corpus import last_written
from tessera.operators.ranking import ranked

GROUP = ["hyp_id", "model"]


def weighted(cells: DataFrame, data_points: DataFrame) -> DataFrame:
    """Cells with the credibility of their data point's latest record; 1 where there is none."""
    meta = last_written(data_points.select("dp_id", "written_at", "meta").where("dp_id is not null"), ["dp_id"], ["written_at"])
    return cells.join(meta.select("dp_id", scale.credibility("meta").alias("cred")), "dp_id", "left").withColumn("cred", F.coalesce("cred", F.lit(1.0)))


def hypothesis_scores(cells: DataFrame) -> DataFrame:
    """Per hypothesis and model: the credibility-weighted sum of log lifts, counts, and the verdict of sum over count."""
    score = F.sum(F.col("log_lift") * F.col("cred"))
    sums = cells.groupBy(*GROUP).agg(
        score.alias("score"), F.count("*").alias("n"), F.count_if(scale.supports("verdict")).alias("n_supporting"), F.count_if(scale.contradicts("verdict")).alias("n_contradicting")
    )
    mean = F.round(F.col("score") / F.greatest("n", F.lit(1)), 9)
    return sums.select(*GROUP, "score", "n", "n_supporting", "n_contradicting", (F.col("n") - F.col("n_supporting") - F.col("n_contradicting")).alias("n_neutral"), scale.verdict(mean).alias("verdict"))


def best_worst(cells: DataFrame) -> DataFrame:
    """The cells of the greatest and least log lift of each hypothesis; ties go to the smaller data point."""
    worst, best = F.struct("log_lift", "dp_id"), F.struct((-F.col("log_lift")).alias("neg"), F.col("dp_id"))
    return cells.groupBy(*GROUP).agg(F.min(worst).alias("w"), F.min(best).alias("b")).select(*GROUP, F.col("w.dp_id").alias("worst_dp"), F.col("w.log_lift").alias("worst"), F.col("b.dp_id").alias("best_dp"), (-F.col("b.neg")).alias("best"))


def diagnosticity(cells: DataFrame) -> DataFrame:
    """The population variance of a data point's log lifts over hypotheses, per model."""
    return cells.groupBy("dp_id", "model").agg(F.coalesce(F.var_pop("log_lift"), F.lit(0.0)).alias("diagnosticity"), F.count("*").alias("n_hyps"))


def top(rows: DataFrame, by: str, k: int, descending: bool = True) -> DataFrame:
    """The ``k`` rows first by a value rounded to six places, ties by data point and model."""
    v = F.round(by, 6)
    return rows.withColumn(by, v).orderBy(F.desc(by) if descending else F.asc(by), "dp_id", "model").limit(k)


def detail(cells: DataFrame, data_points: DataFrame) -> DataFrame:
    """Every hypothesis' evidence, ranked from the most contradicting, with its source."""
    latest = last_written(data_points.select("dp_id", "doc_id", "meta", "written_at").where("dp_id is not null"), ["dp_id"], ["written_at"])
    cited = cells.join(latest.select("dp_id", text.source_of("meta", "doc_id").alias("source")), "dp_id", "left")
    rows = cited.select(*GROUP, "dp_id", F.col("log_lift").alias("exact"), F.round("log_lift", 6).alias("log_lift"), "verdict", "source")
    return ranked(rows, GROUP, [F.asc("exact"), F.asc("dp_id")]).drop("exact")


def wide(cells: DataFrame, rows: list[str], column: str, values: list[str]) -> DataFrame:
    """The grid with a column for each of the given ``values``."""
    return cells.groupBy(*rows).pivot(column, values).agg(F.round(F.max("log_lift"), 6))


def verdict_histogram(cells: DataFrame) -> DataFrame:
    return cells.groupBy("model", "verdict").agg(F.count("*").alias("n"))


def by_score(results: DataFrame) -> DataFrame:
    """``results`` with their rank per model, from the greatest score; ties by hypothesis. A row a hypothesis and model."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("score"), "hyp_id")))


def of_hypothesis(rows: DataFrame, hyp_id: str) -> DataFrame:
    """The rows of one hypothesis; a LookupError where there is none."""
    own = rows.where(F.col("hyp_id") == hyp_id)
    if own.isEmpty():
        raise LookupError(f"hypothesis not found: {hyp_id}")
    return own


def points_of(data_points: DataFrame, doc_id: Column) -> DataFrame:
    """The latest records of the data points of a document."""
    latest = last_written(data_points.where("dp_id is not null"), ["dp_id"], ["written_at"])
    return latest.where(F.col("doc_id") == doc_id)


def report_ends(results: DataFrame, cells: DataFrame, data_points: DataFrame) -> DataFrame:
    """Per model: the best evidence of the hypothesis of the greatest score and the worst of that of the least, with its text."""
    ranked_ = by_score(results).withColumn("n_hyps", F.count("*").over(Window.partitionBy("model")))
    ends = ranked_.where("rank = 1 or rank = n_hyps").select("hyp_id", "model", F.explode(F.expr("filter(array(if(rank = 1, 'top', null), if(rank = n_hyps, 'bottom', null)), x -> x is not null)")).alias("place"))
    evidence = best_worst(cells).join(ends, GROUP).select("model", "place", "hyp_id", F.when(F.col("place") == "top", F.col("best_dp")).otherwise(F.col("worst_dp")).alias("dp_id"))
    latest = last_written(data_points.select("dp_id", "text", "written_at").where("dp_id is not null"), ["dp_id"], ["written_at"])
    return evidence.join(latest.select("dp_id", "text"), "dp_id", "left").select("model", "place", "hyp_id", "dp_id", "text")


def point_rows(cells: DataFrame, data_points: DataFrame) -> DataFrame:
    """(dp_id, model, source, credibility, noise, diagnosticity): what the matrix tells of each data point; credibility as it is written."""
    latest = last_written(data_points.select("dp_id", "doc_id", "text", "meta", "written_at").where("dp_id is not null"), ["dp_id"], ["written_at"])
    told = latest.select("dp_id", "text", text.source_of("meta", "doc_id").alias("source"), F.get_json_object("meta", "$.credibility").alias("credibility"), F.get_json_object("meta", "$.noise").alias("noise"))
    return diagnosticity(cells).join(told, "dp_id").select("dp_id", "model", "text", "source", "credibility", "noise", F.round("diagnosticity", 3).alias("diagnosticity"))


def points_json(points: DataFrame) -> DataFrame:
    """(kind, key, model, json) of ``point_rows``, to stand beside the lines of ``matrix_json``."""
    return points.select(F.lit("data_point").alias("kind"), F.col("dp_id").alias("key"), "model", F.to_json(F.struct("dp_id", "text", "source", "credibility", "noise", "diagnosticity")).alias("json"))


def refutations_json(sets: DataFrame, texts: DataFrame, cells: DataFrame) -> DataFrame:
    """(hyp_id, set_key, json) of refuting sets: members with their texts and own lifts, the joint lift, and whether only the set refutes."""
    each = sets.select("hyp_id", "set_key", F.posexplode("members").alias("pos", "dp_id")).join(texts.select("dp_id", "text"), "dp_id", "left").join(cells.select("hyp_id", "dp_id", F.round("lift", 4).alias("own")), ["hyp_id", "dp_id"], "left")
    told = each.groupBy("hyp_id", "set_key").agg(F.array_sort(F.collect_list(F.struct("pos", "dp_id", "text", "own"))).alias("m"))
    take = lambda c: F.transform("m", lambda x: x[c])
    line = F.struct(take("dp_id").alias("dp_ids"), F.filter(take("text"), lambda t: t.isNotNull()).alias("data_points"), F.size("m").alias("size"), F.round("joint_lift", 4).alias("joint_lift"), F.map_from_arrays(take("dp_id"), take("own")).alias("member_lifts"), "conjunction_only", "llm_calls")
    return sets.join(told, ["hyp_id", "set_key"]).select("hyp_id", "set_key", F.to_json(line).alias("json"))


def residuals_json(found: DataFrame) -> DataFrame:
    """(cluster, json) of proposed hypotheses (cluster, dp_ids, size, coherence, hypothesis, explained, admitted)."""
    line = F.struct("dp_ids", "size", F.round("coherence", 4).alias("coherence"), F.col("hypothesis").alias("abduced_hypothesis"), F.round("explained", 3).alias("explains_fraction"), "admitted")
    return found.select("cluster", F.to_json(line).alias("json"))


def matrix_json(cells: DataFrame, results: DataFrame) -> DataFrame:
    """(kind, key, model, json): the matrix as JSON lines, one a hypothesis' result (with its text, where the results bring it) and one a cell (``hyp|dp``), rounded for output.

    Lines keep a hypothesis with very many cells from becoming one document.
    """
    cell = F.to_json(F.struct(F.round("lift", 3).alias("lift"), F.round("log_lift", 3).alias("log_lift"), F.round("relatedness", 3).alias("relatedness"), "change", "verdict"))
    own = ["text"] if "text" in results.columns else []
    result = F.to_json(F.struct(*own, F.round("score", 3).alias("score"), "verdict", "n", "n_supporting", "n_contradicting", "n_neutral"))
    lines = cells.select(F.lit("cell").alias("kind"), F.concat_ws("|", "hyp_id", "dp_id").alias("key"), "model", cell.alias("json"))
    return lines.unionByName(results.select(F.lit("result").alias("kind"), F.col("hyp_id").alias("key"), "model", result.alias("json")))
