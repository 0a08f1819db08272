"""Sets of data points that jointly refute a hypothesis: structural screen, joint lift, greedy growth, minimal sets.

The search runs over a frontier of all hypotheses and seeds at once. With the lexical oracle the joint label of a set is
a function of how many members carry a negative cue and how many share a word with the hypothesis, so a trial is
an aggregate over members and no text is read again. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scale, text
from tessera.operators.ranking import first_k
from tessera.plans.settings import DEFAULTS, Settings
from tessera.plans.shared import cut

STATE = ["hyp_id", "seed", "members", "lift"]


def pairwise_refutations(cells: DataFrame, threshold: float = DEFAULTS.refute_lift) -> DataFrame:
    """The baseline: cells that refute by themselves."""
    return cells.where(F.col("lift") < threshold).select("hyp_id", "dp_id", "model", F.round("lift", 6).alias("lift"))


def evidence(cells: DataFrame, hyps: DataFrame, points: DataFrame) -> DataFrame:
    """(hyp_id, dp_id, lift, neg, pos, prior, ents, toks): what the search needs to know of each cell; entities and words are hashed."""
    hashed = lambda xs: F.transform(xs, lambda x: F.xxhash64(x))
    h = hyps.select("hyp_id", text.oracle_tokens("text").alias("htoks"))
    p = points.select("dp_id", text.negative("text").alias("neg"), text.lexical_prior("text").alias("prior"), text.oracle_tokens("text").alias("dtoks"), hashed(text.entities("text", "meta")).alias("ents"), hashed(text.screen_tokens("text")).alias("toks"))
    pos = F.arrays_overlap("htoks", "dtoks")
    return cells.select("hyp_id", "dp_id", "lift").join(h, "hyp_id").join(p, "dp_id").select("hyp_id", "dp_id", "lift", F.col("neg").cast("int").alias("neg"), pos.cast("int").alias("pos"), "prior", "ents", "toks")


def seeds(ev: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The cells of least lift that do not refute alone, first by lift; where all refute, the least of all."""
    mild = F.col("lift") >= settings.refute_lift
    any_mild = ev.groupBy("hyp_id").agg(F.max(mild.cast("int")).alias("any_mild"))
    pool = ev.select("hyp_id", "dp_id", "lift").join(any_mild, "hyp_id").where(mild | (F.col("any_mild") == 0))
    ranked = first_k(pool.drop("any_mild"), ["hyp_id"], [F.asc("lift"), F.asc("dp_id")], settings.seeds)
    return ranked.select("hyp_id", (F.col("rank") - 1).alias("seed"), "dp_id", "lift")


def shortlists(frontier: DataFrame, ev: DataFrame, limit: int) -> DataFrame:
    """(hyp_id, seed, cand, rank): data points by ten times shared entities plus shared words with the set, above zero.

    A set meets the cells of its hypothesis once: a hypothesis has a few sets, so the join has a few rows a cell.
    """
    inside = frontier.select("hyp_id", "seed", "members", F.explode("members").alias("dp_id")).join(ev.select("hyp_id", "dp_id", "ents", "toks"), ["hyp_id", "dp_id"])
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))  # noqa: E731 - of the members of one set
    sets = inside.groupBy("hyp_id", "seed").agg(F.first("members").alias("members"), union("ents").alias("_ents"), union("toks").alias("_toks"))
    score = 10 * F.size(F.array_intersect("ents", "_ents")) + F.size(F.array_intersect("toks", "_toks"))
    scored = ev.select("hyp_id", "dp_id", "ents", "toks").join(sets, "hyp_id").where(~F.array_contains("members", F.col("dp_id"))).select("hyp_id", "seed", "dp_id", score.cast("long").alias("score")).where("score > 0")
    first = first_k(scored, ["hyp_id", "seed"], [F.desc("score"), F.asc("dp_id")], limit)
    return first.select("hyp_id", "seed", F.col("dp_id").alias("cand"), "rank", "score")


def joint_lifts(trials: DataFrame, ev: DataFrame) -> DataFrame:
    """``trials(hyp_id, trial, members)`` with the lift of the members taken together.

    None gives 1 and one gives its cell's lift; the prior of a set is its least member's.
    """
    members = trials.select("hyp_id", "trial", F.explode_outer("members").alias("dp_id"))
    sums = members.join(ev.select("hyp_id", "dp_id", "lift", "neg", "pos", "prior"), ["hyp_id", "dp_id"], "left").groupBy("hyp_id", "trial").agg(
        F.count("dp_id").alias("n"), F.coalesce(F.sum("neg"), F.lit(0)).alias("neg"), F.coalesce(F.sum("pos"), F.lit(0)).alias("pos"), F.min("prior").alias("prior"), F.min("lift").alias("own")
    )
    joint = scale.lift_of_change(text.joint_change("neg", "pos"), F.coalesce("prior", F.lit(0.5)))
    lift = F.when(F.col("n") == 0, 1.0).when(F.col("n") == 1, F.col("own")).otherwise(joint)
    return trials.join(sums.select("hyp_id", "trial", lift.alias("joint_lift")), ["hyp_id", "trial"])


def _trials(rows: DataFrame) -> DataFrame:
    return rows.withColumn("trial", F.xxhash64("seed", F.array_join("members", ",")))


def grown(ev: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Frontier rows that came below the threshold (hyp_id, seed, members, lift), and the joint lifts judged (hyp_id, seed, calls)."""
    frontier = cut(seeds(ev, settings).select("hyp_id", "seed", F.array("dp_id").alias("members"), "lift"))
    done: DataFrame | None = None
    calls: DataFrame | None = None
    for _ in range(settings.set_size - 1):
        listed = shortlists(frontier, ev, settings.shortlist).join(frontier, ["hyp_id", "seed"])
        trials = listed.select("hyp_id", "seed", "rank", "lift", F.concat("members", F.array("cand")).alias("members"))
        judged = joint_lifts(_trials(trials), ev)
        better = F.when(F.col("joint_lift") < F.col("lift"), F.struct("joint_lift", "rank", "members"))
        best = cut(judged.groupBy("hyp_id", "seed").agg(F.count("*").alias("calls"), F.min(better).alias("x")))
        spent = best.select("hyp_id", "seed", "calls")
        calls = spent if calls is None else calls.unionByName(spent)
        grew = best.where("x is not null").select("hyp_id", "seed", "x.members", F.col("x.joint_lift").alias("lift"))
        refuting = F.col("lift") < settings.refute_lift
        ended = grew.where(refuting).select(STATE)
        done = ended if done is None else done.unionByName(ended)
        frontier = grew.where(~refuting).select(STATE)
        if frontier.isEmpty():
            break
    assert done is not None and calls is not None
    return cut(done), calls.groupBy("hyp_id", "seed").agg(F.sum("calls").alias("calls"))


def minimised(sets: DataFrame, ev: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Sets without the members they do not need: the first whose removal still refutes goes, until none does; never below two."""
    current = sets
    for _ in range(max(0, settings.set_size - 2)):
        large = current.where(F.size("members") > 2)
        if large.isEmpty():
            break
        drops = large.select("hyp_id", "seed", F.posexplode("members").alias("pos", "gone"), F.col("members").alias("whole"))
        trials = _trials(drops.select("hyp_id", "seed", "pos", F.array_remove("whole", F.col("gone")).alias("members")))
        still = joint_lifts(trials, ev).where(F.col("joint_lift") < settings.refute_lift)
        first = still.groupBy("hyp_id", "seed").agg(F.min_by(F.struct("members", F.col("joint_lift").alias("lift")), "pos").alias("x")).select("hyp_id", "seed", "x.members", "x.lift")
        current = cut(current.join(first, ["hyp_id", "seed"], "left_anti").unionByName(first))
    return current


def refuting_sets(ev: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(hyp_id, seed, set_key, members, joint_lift, joint_log_lift, conjunction_only, llm_calls); a set found from several seeds counts once."""
    sets, calls = grown(ev, settings)
    minimal = minimised(sets, ev, settings).withColumn("set_key", text.set_key("members"))
    first = minimal.groupBy("hyp_id", "set_key").agg(F.min_by(F.struct("seed", "members", "lift"), "seed").alias("x")).select("hyp_id", "set_key", "x.seed", "x.members", "x.lift")
    alone = first.select("hyp_id", "set_key", F.explode("members").alias("dp_id")).join(ev.select("hyp_id", "dp_id", F.col("lift").alias("own")), ["hyp_id", "dp_id"]).groupBy("hyp_id", "set_key").agg(F.min("own").alias("least"))
    total = F.sum("calls").over(Window.partitionBy("hyp_id").orderBy("seed"))
    spent = calls.withColumn("llm_calls", total).drop("calls")
    out = first.join(alone, ["hyp_id", "set_key"]).join(spent, ["hyp_id", "seed"])
    # the default threshold decides what refutes alone, whatever threshold the search had
    return out.select("hyp_id", "seed", "set_key", "members", F.round("lift", 6).alias("joint_lift"), F.round(F.ln(F.greatest("lift", F.lit(1e-6))), 6).alias("joint_log_lift"), (F.col("least") >= DEFAULTS.refute_lift).alias("conjunction_only"), "llm_calls")
