"""Queries of the lift model over the corpus tables, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scale, text
from tessera.functions.vectors import sparse_hashing, sparse_tfidf
from tessera.operators import corpus, dense, matrix, refute, residual, scoring
from tessera.operators.ranking import ranked
from tessera.plans import settings as S
from tessera.plans.shared import cut, stored, table

Q = DataFrame


#: Columns that the wide view has at most.
MOST_MODELS = 1_000


def _cells(spark: SparkSession, d: str) -> Q:
    return scoring.cached_cells(table(spark, d, "lift_cache"))


def _weighted(spark: SparkSession, d: str) -> Q:
    return matrix.weighted(_cells(spark, d), table(spark, d, "data_points"))


def _points(spark: SparkSession, d: str) -> Q:
    """The latest record of each data point."""
    return corpus.last_written(table(spark, d, "data_points").where("dp_id is not null"), ["dp_id"], ["written_at"])


def _docs(spark: SparkSession, d: str) -> Q:
    return table(spark, d, "documents").select("doc_id", "text")


# ---------------------------------------------------------------------------------------------- corpus
def sentence_split(spark: SparkSession, d: str) -> Q:
    return corpus.sentence_rows(_docs(spark, d))


def sentence_stats(spark: SparkSession, d: str) -> Q:
    return sentence_split(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"))


def content_ids(spark: SparkSession, d: str) -> Q:
    rows = table(spark, d, "data_points").where("text is not null").select("dp_id", text.content_id("text").alias("content_id"))
    return rows.dropDuplicates()


def hash_embed_norms(spark: SparkSession, d: str) -> Q:
    v = sparse_hashing(_points(spark, d), ["dp_id"], "text")
    return v.groupBy("dp_id").agg(F.count("*").alias("n_buckets"), F.round(F.max("weight"), 6).alias("largest"), F.round(F.sum("weight"), 6).alias("total"))


def adjacent_similarity(spark: SparkSession, d: str) -> Q:
    return corpus.adjacent_similarity(_docs(spark, d))


def trough_threshold(spark: SparkSession, d: str) -> Q:
    # values lie on quarters of the sixth place: the nudge keeps halves from rounding either way
    return corpus.trough_thresholds(_docs(spark, d)).withColumn("threshold", F.round(F.col("threshold") + 1e-9, 6))


def semantic_chunks(spark: SparkSession, d: str) -> Q:
    return corpus.chunks_of(_docs(spark, d)).select("doc_id", "ord", "n_sentences", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def chunk_atoms(spark: SparkSession, d: str) -> Q:
    rows = table(spark, d, "chunks").where("chunk_id is not null and text is not null").select("doc_id", "chunk_id", "ord", "text").dropDuplicates()
    return corpus.atoms_of(rows).groupBy("chunk_id").agg(F.count("*").alias("n_atoms"), F.max(F.length("text")).alias("longest"))


def dedup_atoms_last_writer(spark: SparkSession, d: str) -> Q:
    rows = table(spark, d, "chunks").where("chunk_id is not null and text is not null and ord is not null").select("doc_id", "chunk_id", "ord", "text").dropDuplicates()
    return corpus.data_points_of(corpus.atoms_of(rows)).select("dp_id", "chunk_id", "doc_id")


def latest_data_points(spark: SparkSession, d: str) -> Q:
    return _points(spark, d).select("dp_id", "written_at")


def live_documents(spark: SparkSession, d: str) -> Q:
    return corpus.live(table(spark, d, "documents"), table(spark, d, "tombstones"), "documents", "doc_id", "ingested_at").select("doc_id", "ingested_at")


def live_data_points(spark: SparkSession, d: str) -> Q:
    rows = corpus.live(table(spark, d, "data_points").where("dp_id is not null"), table(spark, d, "tombstones"), "data_points", "dp_id", "written_at")
    return rows.groupBy("dp_id").agg(F.max("written_at").alias("written_at"))


# ---------------------------------------------------------------------------------------------- text
def _tokens(name: str, col: Callable[[], F.Column]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> Q:
        return _points(spark, d).where("text is not null").select("dp_id", F.array_join(F.array_sort(col()), " ").alias(name))

    return query


def entity_sets(spark: SparkSession, d: str) -> Q:
    """Capitalised words, dates, figures and the source of each data point, as the structural screen compares them."""
    return _points(spark, d).where("text is not null").select("dp_id", F.array_join(F.array_sort(text.entities("text", "meta")), " ").alias("entities"))


def priors(spark: SparkSession, d: str) -> Q:
    return _points(spark, d).where("text is not null").select("dp_id", text.lexical_prior("text").alias("prior"))


def lexical_pairs(spark: SparkSession, d: str) -> Q:
    """The lexical judgement of every pair that the cache holds."""
    pairs = table(spark, d, "lift_cache").select("hyp_id", "dp_id").dropDuplicates()
    hyps = table(spark, d, "hypotheses").select("hyp_id", F.col("text").alias("hyp"))
    judged = scoring.LexicalOracle().cells(pairs.join(hyps, "hyp_id").join(_points(spark, d).select("dp_id", F.col("text").alias("dp")), "dp_id"))
    done = scoring.finished(judged, "lexical")
    return done.select("hyp_id", "dp_id", "change", "prior", "relatedness", F.round("lift", 6).alias("lift"), F.round("log_lift", 6).alias("log_lift"), "verdict")


def lexical_cells(spark: SparkSession, d: str) -> Q:
    """All lexical cells that are not neutral, of all hypotheses and all data points."""
    return scoring.lexical_cells(table(spark, d, "hypotheses").select("hyp_id", "text"), _points(spark, d).where("text is not null").select("dp_id", "text"))


def parsed_replies(spark: SparkSession, d: str) -> Q:
    raw = table(spark, d, "lift_cache").where("rationale like '%{%'").select("hyp_id", "dp_id", "model", text.oracle_json("rationale").alias("j")).dropDuplicates()
    return raw.groupBy(F.get_json_object("j", "$.change").alias("change"), F.col("j").isNotNull().alias("parsed")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------------------------------------- scale
def change_labels(spark: SparkSession, d: str) -> Q:
    return table(spark, d, "lift_cache").groupBy(scale.change_label("change").alias("label")).agg(F.count("*").alias("n"))


def lift_scale(spark: SparkSession, d: str) -> Q:
    """The stored multiplier of each label against the scale (priors as the latest record has them, else the default)."""
    prior = _points(spark, d).select("dp_id", F.coalesce("prior", F.lit(S.DEFAULT_PRIOR)).alias("prior"))
    rows = _cells(spark, d).join(prior, "dp_id", "left").withColumn("prior", F.coalesce("prior", F.lit(S.DEFAULT_PRIOR)))
    derived = rows.withColumn("derived", F.round(scale.lift_of_change("change", "prior"), 6))
    return derived.groupBy("change").agg(F.count("*").alias("n"), F.round(F.min("derived"), 6).alias("least"), F.round(F.max("derived"), 6).alias("greatest"))


def verdict_histogram(spark: SparkSession, d: str) -> Q:
    return matrix.verdict_histogram(_cells(spark, d))


# ---------------------------------------------------------------------------------------------- matrix
def hypothesis_scores(spark: SparkSession, d: str) -> Q:
    """Flagship: every hypothesis' score, verdict and counts, per model."""
    return matrix.hypothesis_scores(_weighted(spark, d)).withColumn("score", F.round("score", 6) + 0.0)


def best_worst_cells(spark: SparkSession, d: str) -> Q:
    return matrix.best_worst(_cells(spark, d)).withColumns({c: F.round(c, 6) for c in ("worst", "best")})


def diagnosticity(spark: SparkSession, d: str) -> Q:
    return matrix.diagnosticity(_cells(spark, d)).withColumn("diagnosticity", F.round("diagnosticity", 6))


def diagnosticity_top(spark: SparkSession, d: str) -> Q:
    return matrix.top(matrix.diagnosticity(_cells(spark, d)), "diagnosticity", 5)


def diagnosticity_bottom(spark: SparkSession, d: str) -> Q:
    return matrix.top(matrix.diagnosticity(_cells(spark, d)), "diagnosticity", 5, descending=False)


def hypothesis_detail(spark: SparkSession, d: str) -> Q:
    return matrix.detail(_cells(spark, d), table(spark, d, "data_points"))


def matrix_wide(spark: SparkSession, d: str) -> Q:
    """Cells with one column of log lifts per verdict-giving model."""
    cells = _cells(spark, d)
    models = sorted(r.model for r in cells.select("model").dropDuplicates().limit(MOST_MODELS + 1).collect())
    if len(models) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models: read the cells in long form")
    return matrix.wide(cells, ["hyp_id", "dp_id"], "model", models).withColumnsRenamed({m: m.replace("-", "_") for m in models})


def matrix_documents(spark: SparkSession, d: str) -> Q:
    lines = matrix.matrix_json(_cells(spark, d), hypothesis_scores(spark, d))
    return lines.select("kind", "key", "model", F.get_json_object("json", "$.verdict").alias("verdict"), F.get_json_object("json", "$.change").alias("change"), F.get_json_object("json", "$.n").alias("n"))


def cache_misses(spark: SparkSession, d: str) -> Q:
    """Pairs judged by some model that ``oracle-a`` has not judged."""
    cache = table(spark, d, "lift_cache").where("hyp_id is not null and dp_id is not null and model is not null")
    wanted = cache.select("hyp_id", "dp_id").dropDuplicates().withColumn("model", F.lit("oracle-a"))
    return scoring.misses(wanted, cache)


def cache_merge(spark: SparkSession, d: str) -> Q:
    """The cache after an upsert of ``oracle-c``'s cells under the name of ``oracle-a``."""
    cells = _cells(spark, d).select("hyp_id", "dp_id", "model", F.round("lift", 6).alias("lift"))
    new = cells.where("model = 'oracle-c'").withColumn("model", F.lit("oracle-a"))
    return corpus.upsert(cells, new, ["hyp_id", "dp_id", "model"])


def ranked_hypotheses(spark: SparkSession, d: str) -> Q:
    """Hypotheses in order of score, per model."""
    return matrix.by_score(hypothesis_scores(spark, d)).select("hyp_id", "model", "score", "rank")


def diagnostic_order(spark: SparkSession, d: str) -> Q:
    """Data points in order of diagnosticity, per model."""
    rows = matrix.diagnosticity(_cells(spark, d)).select("dp_id", "model", F.round("diagnosticity", 6).alias("diagnosticity"))
    return ranked(rows, ["model"], [F.desc("diagnosticity"), F.asc("dp_id")])


def matrix_points(spark: SparkSession, d: str) -> Q:
    """What the matrix tells of each data point."""
    return matrix.point_rows(_cells(spark, d), table(spark, d, "data_points")).drop("text")


def matrix_by_hypothesis(spark: SparkSession, d: str) -> Q:
    """The matrix of the first scenario: data points by its hypotheses, in the order of their ids, as columns of the greatest log lift of any model."""
    hyps = table(spark, d, "hypotheses").select("hyp_id", F.get_json_object("meta", "$.scenario").alias("scenario")).where("scenario is not null")
    own = hyps.join(hyps.agg(F.min("scenario").alias("scenario")), "scenario", "left_semi")
    ids = [r.hyp_id for r in own.select("hyp_id").dropDuplicates().orderBy("hyp_id").limit(MOST_MODELS + 1).collect()]
    if len(ids) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} hypotheses: read the cells in long form")
    cells = _cells(spark, d).join(own.select("hyp_id"), "hyp_id", "left_semi")
    return matrix.wide(cells, ["dp_id"], "hyp_id", ids).withColumnsRenamed({h: f"h{k + 1}" for k, h in enumerate(ids)})


def report_ends(spark: SparkSession, d: str) -> Q:
    """The best evidence of the first hypothesis and the worst of the last, per model."""
    return matrix.report_ends(hypothesis_scores(spark, d), _cells(spark, d), table(spark, d, "data_points"))


def hypothesis_view(spark: SparkSession, d: str) -> Q:
    """The evidence of one hypothesis: the one with the most cells (ties: the smaller id)."""
    cells = _cells(spark, d)
    most = cells.groupBy("hyp_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hyp_id").first()
    if most is None:
        return hypothesis_detail(spark, d)
    return matrix.detail(matrix.of_hypothesis(cells, most.hyp_id), table(spark, d, "data_points"))


def document_points(spark: SparkSession, d: str) -> Q:
    """Every document's data points by their latest record: how many, and their texts as one digest."""
    rows = _points(spark, d).where("doc_id is not null and text is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("dp_id", "text"))).alias("x"))
    return rows.select("doc_id", F.size("x").cast("long").alias("n_data_points"), F.md5(F.encode(F.array_join(F.transform("x", lambda p: p["text"]), "|"), "UTF-8")).alias("texts_md5"))


def scenario_hypotheses(spark: SparkSession, d: str) -> Q:
    """Hypotheses by the scenario in their meta."""
    return table(spark, d, "hypotheses").groupBy(F.get_json_object("meta", "$.scenario").alias("scenario")).agg(F.count("*").alias("n"), F.min("hyp_id").alias("first_hyp"))


def _asked(spark: SparkSession, d: str) -> tuple[Q, Q]:
    """All hypotheses, and all data points with their weights, for the lexical grid."""
    points = _points(spark, d).where("text is not null").select("dp_id", "text", scale.credibility("meta").alias("cred"))
    return table(spark, d, "hypotheses").where("text is not null").select("hyp_id", "text"), points


def grid_scores(spark: SparkSession, d: str) -> Q:
    """Every hypothesis scored by the lexical oracle against every data point."""
    return scoring.lexical_scores(*_asked(spark, d)).withColumn("score", F.round("score", 6) + 0.0)


def grid_diagnosticity(spark: SparkSession, d: str) -> Q:
    """The diagnosticity of every data point over the lexical grid."""
    return scoring.lexical_diagnosticity(*_asked(spark, d)).withColumn("diagnosticity", F.round("diagnosticity", 6))


def grid_detail(spark: SparkSession, d: str) -> Q:
    """The lexical evidence that bears on each hypothesis, from the most contradicting, with its source."""
    return matrix.detail(scoring.lexical_lifts(*_asked(spark, d)), table(spark, d, "data_points")).select("hyp_id", "dp_id", "log_lift", "verdict", "source", "rank")


def tfidf_norms(spark: SparkSession, d: str) -> Q:
    """TF-IDF of the words of data points, by document: distinct words and the greatest weight."""
    v = sparse_tfidf(_points(spark, d).where("doc_id is not null and text is not null"), "doc_id", ["dp_id"], "text")
    return v.groupBy("doc_id", "dp_id").agg(F.count("*").alias("n_terms"), F.round(F.max("weight"), 6).alias("largest"))


# ---------------------------------------------------------------------------------------------- refutation, residuals
def pairwise_refutations(spark: SparkSession, d: str) -> Q:
    return refute.pairwise_refutations(_cells(spark, d))


def _evidence(spark: SparkSession, d: str) -> Q:
    cells = _cells(spark, d).groupBy("hyp_id", "dp_id").agg(F.min("lift").alias("lift"))
    points = _points(spark, d).where("text is not null").select("dp_id", "text", "meta")
    return cut(refute.evidence(cells, table(spark, d, "hypotheses").select("hyp_id", "text"), points))


def refutation_seeds(spark: SparkSession, d: str) -> Q:
    cells = _cells(spark, d).groupBy("hyp_id", "dp_id").agg(F.min("lift").alias("lift"))
    return refute.seeds(cells).withColumn("lift", F.round("lift", 6))


def structural_candidates(spark: SparkSession, d: str) -> Q:
    ev = _evidence(spark, d)
    frontier = refute.seeds(ev).select("hyp_id", "seed", F.array("dp_id").alias("members"))
    return refute.shortlists(frontier, ev, S.DEFAULTS.shortlist)


def joint_lift_pairs(spark: SparkSession, d: str) -> Q:
    """The joint lift of each seed with each data point of its shortlist."""
    ev = _evidence(spark, d)
    seeds = refute.seeds(ev).select("hyp_id", "seed", F.col("dp_id").alias("first"))
    listed = refute.shortlists(seeds.select("hyp_id", "seed", F.array("first").alias("members")), ev, S.DEFAULTS.shortlist)
    trials = listed.join(seeds, ["hyp_id", "seed"]).select("hyp_id", "seed", "cand", F.array("first", "cand").alias("members"), F.xxhash64("seed", "cand").alias("trial"))
    return refute.joint_lifts(trials, ev).select("hyp_id", "seed", "cand", F.round("joint_lift", 6).alias("joint_lift"))


def refuting_sets(spark: SparkSession, d: str) -> Q:
    found = refute.refuting_sets(_evidence(spark, d))
    return found.select("hyp_id", "seed", "set_key", "joint_lift", "joint_log_lift", "conjunction_only", "llm_calls")


def residual_points(spark: SparkSession, d: str) -> Q:
    return residual.residuals(_cells(spark, d)).select("dp_id", "model", F.round("residual", 6).alias("residual"))


def residual_counts(spark: SparkSession, d: str) -> Q:
    return residual.residuals(_cells(spark, d)).groupBy("model").agg(F.count("*").alias("n"))


def retrieval_topk(spark: SparkSession, d: str) -> Q:
    return residual.retrieval_baseline(table(spark, d, "hypotheses"), _points(spark, d).where("text is not null"))


def _members(spark: SparkSession, d: str) -> Q:
    """Residual data points with their text, whatever document they come from."""
    ids = residual.residuals(_cells(spark, d)).select("dp_id").dropDuplicates()
    return stored(_points(spark, d).where("text is not null").join(ids, "dp_id", "left_semi").select("doc_id", "dp_id", "text"))


def _whole(rows: Q) -> Q:
    """``rows`` as one case: clusters are sought in the whole table."""
    return rows.select(F.lit(0).alias("case_id"), "dp_id", "text")


def residual_clusters(spark: SparkSession, d: str) -> Q:
    return residual.clusters(_whole(_members(spark, d)), "case_id").select("cluster", "dp_ids", "size", F.round("coherence", 6).alias("coherence"))


def residual_cluster_checks(spark: SparkSession, d: str) -> Q:
    """One row of what holds of the residual clusters: members are residual points, none is in two clusters, none is too small, and the coherence is that of the members' vectors."""
    rows = _members(spark, d)
    found = stored(residual.clusters(_whole(rows), "case_id").drop("case_id"))
    members = found.select("cluster", F.explode("dp_ids").alias("dp_id"))
    known = members.join(rows.select("dp_id", "text"), "dp_id", "left")
    v = sparse_hashing(known.where("text is not null"), ["cluster", "dp_id"], "text")
    sums = v.groupBy("cluster", "bucket").agg(F.sum("weight").alias("s")).groupBy("cluster").agg(F.sum(F.col("s") * F.col("s")).alias("s"))
    again = found.join(sums, "cluster", "left").select("size", F.size("dp_ids").alias("n"), "coherence", ((F.coalesce("s", F.lit(0.0)) - F.col("size")) / (F.col("size") * (F.col("size") - 1))).alias("again"))
    holds = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    sizes = again.agg(holds((F.col("size") == F.col("n")) & (F.col("size") >= S.DEFAULTS.min_cluster)).alias("sizes"), holds(F.abs(F.col("coherence") - F.col("again")) < 1e-6).alias("coherences"))
    ids = known.agg((F.count("*") == F.count_distinct("dp_id")).alias("disjoint"), holds(F.col("text").isNotNull()).alias("residual"))
    return sizes.join(ids, how="cross")  # one row each


def abduced_terms(spark: SparkSession, d: str) -> Q:
    return residual.abduced(residual.top_terms(_members(spark, d).where("doc_id is not null"), ["doc_id"]))


def missing_hypotheses(spark: SparkSession, d: str) -> Q:
    """Residual clusters, the hypothesis proposed for each, and the share of members it makes likelier."""
    rows = _members(spark, d)
    found = cut(residual.clusters(_whole(rows), "case_id").drop("case_id"))
    members = found.select("cluster", F.explode("dp_ids").alias("dp_id")).join(rows.select("dp_id", F.col("text")), "dp_id")
    proposed = residual.abduced(residual.top_terms(members, ["cluster"]))
    named = proposed.withColumn("hyp_id", text.content_id("hypothesis"))
    pairs = members.join(named, ["cluster"]).select("cluster", "hyp_id", F.col("hypothesis").alias("hyp"), "dp_id", F.col("text").alias("dp"))
    judged = scoring.finished(scoring.LexicalOracle().cells(pairs), "lexical").select("hyp_id", "dp_id", "lift")
    checked = residual.verified(pairs.select("cluster", "hyp_id", "dp_id").join(judged.dropDuplicates(["hyp_id", "dp_id"]), ["hyp_id", "dp_id"]), ["cluster"])
    return found.join(named.select("cluster", "hypothesis"), ["cluster"], "left").join(checked, ["cluster"], "left").select("cluster", "size", F.round("coherence", 6).alias("coherence"), "hypothesis", F.coalesce("explained", F.lit(0.0)).alias("explained"), F.coalesce("admitted", F.lit(False)).alias("admitted"))


def verify_abduction(spark: SparkSession, d: str) -> Q:
    return residual.verified(_cells(spark, d), ["hyp_id", "model"])


def supporting_terms(spark: SparkSession, d: str) -> Q:
    """The words that most of a hypothesis' supporting data points have."""
    held = _cells(spark, d).where(scale.supports("verdict")).select("hyp_id", "dp_id").dropDuplicates()
    return residual.top_terms(held.join(_points(spark, d).where("text is not null").select("dp_id", "text"), "dp_id"), ["hyp_id"])


# ---------------------------------------------------------------------------------------------- vectors
def embedding_coherence(spark: SparkSession, d: str) -> Q:
    return dense.sum_coherence(table(spark, d, "embeddings"), "label", "embedding")


def embedding_separability(spark: SparkSession, d: str) -> Q:
    return dense.pair_statistics(table(spark, d, "embeddings"), "label", "embedding")


QUERIES = {
    **{f.__name__: f for f in (
        sentence_split, sentence_stats, content_ids, hash_embed_norms, adjacent_similarity, trough_threshold, semantic_chunks, chunk_atoms, dedup_atoms_last_writer,
        latest_data_points, live_documents, live_data_points, entity_sets, priors, lexical_pairs, lexical_cells, parsed_replies, change_labels, lift_scale, verdict_histogram, hypothesis_scores,
        ranked_hypotheses, diagnostic_order, matrix_points, matrix_by_hypothesis, report_ends, hypothesis_view, document_points, scenario_hypotheses, grid_scores, grid_diagnosticity, grid_detail, tfidf_norms,
        best_worst_cells, diagnosticity, diagnosticity_top, diagnosticity_bottom, hypothesis_detail, matrix_wide, matrix_documents, cache_misses, cache_merge, pairwise_refutations,
        refutation_seeds, structural_candidates, joint_lift_pairs, refuting_sets, residual_points, residual_counts, retrieval_topk, residual_clusters, residual_cluster_checks, abduced_terms, missing_hypotheses,
        verify_abduction, supporting_terms, embedding_coherence, embedding_separability,
    )},
    "oracle_tokens": _tokens("tokens", lambda: text.oracle_tokens("text")),
    "screen_tokens": _tokens("tokens", lambda: text.screen_tokens("text")),
    "figures": _tokens("figures", lambda: F.array_distinct(F.regexp_extract_all("text", F.lit(S.FIGURE), F.lit(0)))),
}
