"""Queries of the evaluation measures and of the scale over small literal fixtures, with their SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scale, text
from tessera.operators import density, evaluation
from tessera.plans import lift_queries, lift_sql
from tessera.plans import settings as S
from tessera.plans.shared import shared_dir, table
from tessera.sources import scenario
from tessera.streaming.incremental import running_scores

_PLANTED = [("c1", ["d1", "d2", "d3"]), ("c2", ["d2", "d4"]), ("c2", ["d5", "d6"]), ("c3", ["d9"])]
_FOUND = [("c1", ["d1", "d2", "d3", "d7"]), ("c1", ["d1"]), ("c2", ["d4", "d2"]), ("c2", ["d5"])]
_CLAIMS = [("s1", 0, 1.5, False, True), ("s1", 1, 2.5, True, False), ("s1", 2, -3.0, False, True), ("s2", 0, 0.5, False, False), ("s2", 1, 0.5, True, False), ("s3", 0, 1.0, False, False)]
_POINTS = [("s1", 0.1, "irrelevant"), ("s1", 0.9, None), ("s1", 0.3, "duplicate"), ("s2", 0.8, "irrelevant"), ("s2", 0.2, None), ("s3", 0.4, None)]
_CASES = [("conj", False, None, 1.0, 0.0), ("conj", False, None, 0.5, None), ("conj", False, "near_miss", 0.0, 0.0), ("conj", True, None, None, 0.25), ("miss", False, None, 0.75, 0.5)]
_REPLIES = ['{"change": "less"}', '```json\n{"change": "more"}\n```', 'Sure: {"change": "unchanged"} done', "no object", "", None]
_NUMBERS = ["0.7", " 1e-2 ", "very likely", "NaN", "inf", None, "-3", "7.3"]
_OFF_TOPIC = ["The canteen has a new menu this month.", "The lift on the north side is being repaired.", "A choir rehearses in the main hall on Fridays."]


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def guaranteed_scale(spark: SparkSession, d: str) -> DataFrame:
    """The multiplier, log lift and verdict of every label at several priors."""
    labels = [*S.LIFT_OF, S.GUARANTEED, " MORE ", "no label", None]
    grid = [(c, p) for c in labels for p in (1e-4, 0.1, 0.5, 0.999)]
    rows = _rows(spark, grid, "raw string, prior double").withColumn("label", scale.change_label("raw"))
    out = rows.withColumn("lift", scale.lift_of_change("label", "prior"))
    return out.select("raw", "prior", "label", F.round("lift", 6).alias("lift"), F.round(F.ln("lift"), 6).alias("log_lift"), scale.verdict(F.ln("lift")).alias("verdict"))


def safe_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, [(i, x) for i, x in enumerate(_NUMBERS)], "i int, raw string")
    return rows.select("i", scale.safe_double("raw", 0.5).alias("value"))


def oracle_replies(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, [(i, x) for i, x in enumerate(_REPLIES)], "i int, raw string").withColumn("j", text.oracle_json("raw"))
    return rows.select("i", F.get_json_object("j", "$.change").alias("change"), F.col("j").isNotNull().alias("parsed"))


def set_recall(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.set_recall(_rows(spark, _PLANTED, "case_id string, members array<string>"), _rows(spark, _FOUND, "case_id string, members array<string>"))


def cluster_recall(spark: SparkSession, d: str) -> DataFrame:
    found = [(c, i, m) for i, (c, m) in enumerate(_FOUND)]
    planted = [("c1", ["d1", "d2", "d3"]), ("c2", ["d2", "d4", "d5"]), ("c3", ["d9"])]
    return evaluation.cluster_recall(_rows(spark, planted, "case_id string, members array<string>"), _rows(spark, found, "case_id string, pos int, members array<string>"))


def member_recall(spark: SparkSession, d: str) -> DataFrame:
    """What the pairwise baseline finds of the members of planted sets."""
    found = [(c, m) for c, ms in _FOUND for m in ms]
    return evaluation.member_recall(_rows(spark, _PLANTED, "case_id string, members array<string>"), _rows(spark, found, "case_id string, dp_id string"))


def control_findings(spark: SparkSession, d: str) -> DataFrame:
    cases = [(c, k % 2 == 0) for k, c in enumerate(["c1", "c2", "c3", "c4", "c5"])]
    return evaluation.control_findings(_rows(spark, cases, "case_id string, control boolean"), _rows(spark, [(c,) for c, _ in _FOUND], "case_id string"))


def noise_diagnosticity(spark: SparkSession, d: str) -> DataFrame:
    """The third measure over the corpus: by the scenario of the hypotheses, whether off-topic data points are no more diagnostic than the others."""
    hyps = table(spark, d, "hypotheses").select("hyp_id", F.get_json_object("meta", "$.scenario").alias("scenario"))
    cells = lift_queries._cells(spark, d).join(hyps, "hyp_id").where("scenario is not null")
    per_point = cells.groupBy("scenario", "dp_id").agg(F.coalesce(F.var_pop("log_lift"), F.lit(0.0)).alias("diagnosticity"))
    noise = lift_queries._points(spark, d).select("dp_id", F.get_json_object("meta", "$.noise").alias("noise"))
    rows = per_point.join(noise, "dp_id", "left")
    off = F.col("noise").eqNullSafe("irrelevant")
    means = rows.groupBy("scenario").agg(F.count("*").alias("n"), F.round(F.avg(F.when(off, F.col("diagnosticity"))), 6).alias("off_topic"), F.round(F.avg(F.when(~off, F.col("diagnosticity"))), 6).alias("others"))
    return means.withColumn("held", F.col("off_topic") <= F.col("others"))


def scenario_metrics(spark: SparkSession, d: str) -> DataFrame:
    claims = _rows(spark, _CLAIMS, "scenario string, pos int, score double, surviving boolean, eliminated boolean")
    return evaluation.scenario_metrics(claims, _rows(spark, _POINTS, "scenario string, diagnosticity double, noise string"))


def capability_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.report(_rows(spark, _CASES, "capability string, control boolean, adversarial string, recall double, false_positives double"), ["recall", "false_positives"])


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Average linkage at a ladder of thresholds in every case of twenty consecutive vectors, against those of label 0."""
    rows = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("case_id"), F.col("vec_id").cast("string").alias("dp_id"), F.col("embedding").alias("vec"), (F.col("label") == 0).alias("planted"))
    return evaluation.best_threshold(evaluation.threshold_sweep(rows, "case_id", evaluation.ladder(0.6, 1.0), [2, 3]), "case_id")


def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters of all vectors: their sizes, noise as -1."""
    rows = table(spark, d, "embeddings").where("vec_id is not null and embedding is not null").select(F.lit(0).alias("case_id"), "vec_id", "embedding")
    codes = density.coded(rows, "case_id", "vec_id", "embedding", lambda vs: np.stack([np.asarray(x, dtype=float) for x in vs]))
    return density.labelled(codes, "case_id", "vec_id", S.DEFAULTS.min_cluster).groupBy("cluster").agg(F.count("*").alias("size"))


def density_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row of what holds of the density clusters: every vector has one label, and no cluster is too small."""
    found = density_clusters(spark, d)
    small = (F.col("cluster") >= 0) & (F.col("size") < S.DEFAULTS.min_cluster)
    return found.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n_vectors"), (F.count_if(small) == 0).alias("sizes"))


def streamed_scores(spark: SparkSession, d: str) -> DataFrame:
    """Counts and sums of log lifts per hypothesis and model, kept by a stream over the cell table until it has read all of it."""
    source = table(spark, d, "lift_cache")
    name = f"streamed_scores_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/lift_cache.parquet*")
    cells = stream.where("hyp_id is not null and dp_id is not null and model is not null").select("hyp_id", "dp_id", "model", "log_lift")
    folder = f"{shared_dir(spark)}/{name}"
    latest = f"{folder}/out"

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(latest)

    query = running_scores(cells).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(latest).select("hyp_id", "model", "n", (F.round("sum_log_lift", 6) + 0.0).alias("sum_log_lift"))


def noise_injection(spark: SparkSession, d: str) -> DataFrame:
    own = _rows(spark, [("s1", 0, "The log was altered.", 0.8, "NEWS", "{}"), ("s1", 1, "The seal was whole.", 0.6, "HUMINT", "{}")], scenario.EPISODES)
    return scenario.with_noise(own, _OFF_TOPIC, n=4, duplicates=1)


QUERIES = {f.__name__: f for f in (guaranteed_scale, safe_numbers, oracle_replies, set_recall, cluster_recall, member_recall, control_findings, noise_diagnosticity, scenario_metrics, capability_report, threshold_sweep, density_clusters, density_checks, streamed_scores, noise_injection)}


def _values(rows: list[tuple]) -> str:
    def one(v: object) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, list):
            return "[" + ", ".join(map(one, v)) + "]"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


_LABELS = [*S.LIFT_OF, S.GUARANTEED, " MORE ", "no label", None]
_RECALLED = [("c1", ["d1", "d2", "d3"]), ("c2", ["d2", "d4", "d5"]), ("c3", ["d9"])]

SQL = {
    "guaranteed_scale": f"""with r(raw) as (values {_values([(c,) for c in _LABELS])}), p(prior) as (values (1e-4::double), (0.1::double), (0.5::double), (0.999::double)),
        l as (select raw, prior, {lift_sql._label('raw')} "label" from r cross join p), x as (select *, {lift_sql._lift('"label"', 'prior')} lift from l)
        select raw, prior, "label", round(lift, 6) lift, round(ln(lift), 6) log_lift, {lift_sql._verdict('ln(lift)')} verdict from x""",
    "oracle_replies": f"""with r(i, raw) as (values {_values(list(enumerate(_REPLIES)))}), x as (select i, regexp_extract(raw, '(?s)\\{{.*\\}}') j from r), y as (select i, case when j <> '' and json_valid(j) then j end j from x)
        select i::int i, json_extract_string(j, '$.change') change, j is not null parsed from y""",
    "cluster_recall": f"""with p(case_id, m) as (values {_values(_RECALLED)}), f(case_id, pos, m) as (values {_values([(c, i, m) for i, (c, m) in enumerate(_FOUND)])}),
        s as (select p.case_id, pos, coalesce(len(list_intersect(p.m, f.m)), 0) / len(p.m) recall, coalesce(len(list_intersect(p.m, f.m)) / len(f.m), 0.0) purity from p left join f using (case_id))
        select case_id, round(arg_min(recall, (-recall, pos)), 6) recall, round(arg_min(purity, (-recall, pos)), 6) purity from s group by 1""",
    "density_checks": "select count(*) n_vectors, true sizes from embeddings where vec_id is not null and embedding is not null",
    "member_recall": f"""with p as (select distinct case_id, unnest(m) dp_id from (values {_values(_PLANTED)}) t(case_id, m)), f as (select distinct case_id, unnest(m) dp_id, 1 hit from (values {_values(_FOUND)}) t(case_id, m))
        select case_id, round(avg(coalesce(hit, 0)), 6) recall from p left join f using (case_id, dp_id) group by 1""",
    "control_findings": f"""with f as (select case_id, count(*) n from (values {_values([(c,) for c, _ in _FOUND])}) t(case_id) group by 1)
        select case_id, coalesce(n, 0) n_found, coalesce(n, 0) = 0 clean from (values ('c1'), ('c3'), ('c5')) c(case_id) left join f using (case_id)""",
    "noise_diagnosticity": f"""with {lift_sql.POINTS}, {lift_sql.CELLS}, q as (select json_extract_string(h.meta, '$.scenario') scenario, dp_id, coalesce(var_pop(log_lift), 0) x from cells join hypotheses h using (hyp_id) group by all),
        m as (select scenario, count(*) n, round(avg(x) filter (json_extract_string(p.meta, '$.noise') is not distinct from 'irrelevant'), 6) off_topic, round(avg(x) filter (json_extract_string(p.meta, '$.noise') is distinct from 'irrelevant'), 6) others
            from q left join points p using (dp_id) where scenario is not null group by 1)
        select *, off_topic <= others held from m""",
    "streamed_scores": """select hyp_id, model, count(*) n, round(sum(log_lift), 6) + 0.0 sum_log_lift from
        (select hyp_id, dp_id, model, min(log_lift) log_lift from lift_cache where hyp_id is not null and dp_id is not null and model is not null group by all) group by all""",
    "safe_numbers": f"with r(i, raw) as (values {_values(list(enumerate(_NUMBERS)))}), x as (select i, try_cast(trim(raw) as double) v from r) select i::int i, case when v is null or isnan(v) or isinf(v) then 0.5 else v end \"value\" from x",
    "set_recall": f"""with p(case_id, m) as (values {_values(_PLANTED)}), f(case_id, m) as (values {_values(_FOUND)}),
        h as (select p.case_id, p.m, max(coalesce((list_has_all(f.m, p.m))::int, 0)) hit from p left join f using (case_id) group by all)
        select case_id, count(*) n_planted, sum(hit)::bigint n_hit, round(avg(hit), 6) recall from h group by 1""",
    "scenario_metrics": f"""with c(scenario, pos, score, surviving, eliminated) as (values {_values(_CLAIMS)}), q(scenario, diagnosticity, noise) as (values {_values(_POINTS)}),
        r as (select *, row_number() over (partition by scenario order by score desc, pos) rk, count(*) over (partition by scenario) n, avg(score) over (partition by scenario) m from c),
        a as (select scenario, min(case when surviving then (rk <> n)::int::double end) m1, avg(case when eliminated then (score < m)::int::double end) m2 from r group by 1),
        b as (select scenario, avg(diagnosticity) filter (noise is not distinct from 'irrelevant') x, avg(diagnosticity) filter (noise is distinct from 'irrelevant') y from q group by 1)
        select scenario, m1, m2, case when x is not null and y is not null then (x <= y)::int::double end m3 from a left join b using (scenario)""",
    "capability_report": f"""with c(capability, control, adversarial, recall, false_positives) as (values {_values(_CASES)})
        select capability, case when control then 'control' when adversarial is not null then 'adversarial' else 'main' end case_group, count(*) n, round(avg(recall), 6) recall, round(avg(false_positives), 6) false_positives from c group by all""",
}
