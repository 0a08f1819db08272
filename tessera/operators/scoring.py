"""Scoring hypotheses against data points: oracles, the cell cache, and the grid of lexical lifts as a sparse join."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scale, text
from tessera.operators.corpus import last_written
from tessera.plans import settings as S

CELL_KEY = ["hyp_id", "dp_id", "model"]


class Oracle(Protocol):
    """Judges pairs; ``model`` keys the cache."""

    model: str

    def cells(self, pairs: DataFrame) -> DataFrame:
        """(hyp_id, dp_id, change, prior, relatedness, rationale, status) of ``pairs(hyp_id, hyp, dp_id, dp)``, which may bring a ``prior``."""
        ...

    def priors(self, points: DataFrame) -> DataFrame:
        """(dp_id, prior, status) of ``points(dp_id, dp)``."""
        ...


class LexicalOracle:
    """The deterministic oracle: token overlap and cue words, all in column functions."""

    model = "lexical"

    def priors(self, points: DataFrame) -> DataFrame:
        return points.select("dp_id", text.lexical_prior("dp").alias("prior"), F.lit("ok").alias("status"))

    def cells(self, pairs: DataFrame) -> DataFrame:
        overlap = text.jaccard(text.oracle_tokens("hyp"), text.oracle_tokens("dp"))
        judged = pairs.withColumn("overlap", overlap)
        return judged.select(
            "hyp_id", "dp_id", text.lexical_change("overlap", text.negative("dp")).alias("change"), (F.col("prior") if "prior" in pairs.columns else text.lexical_prior("dp")).alias("prior"),
            text.lexical_relatedness("overlap").alias("relatedness"), F.lit("lexical overlap").alias("rationale"), F.lit("ok").alias("status"),
        )


@dataclass(frozen=True)
class Prompts:
    """What a remote oracle is asked; ``{h}``, ``{d}`` and ``{items}`` stand for hypothesis, data point and a list of statements."""

    prior: str = "How probable is this statement before anything else is known? Reply with JSON: {\"prior\": number from 0 to 1}. Statement: {d}"
    relatedness: str = "How far do A and B speak of the same matter? Reply with JSON: {\"relatedness\": number from 0 to 1}. A: {h} B: {d}"
    change: str = "Suppose it were certain that: {h} Would this become more or less probable: {d} Reply with JSON: {\"change\": one of ruled_out, much_less, less, unchanged, more, much_more, guaranteed; \"why\": one sentence}."
    joint: str = "Suppose it were certain that: {h} Would all of these, as one event, become more or less probable? {items} Reply with JSON: {\"change\": one of ruled_out, much_less, less, unchanged, more, much_more, guaranteed; \"why\": one sentence}."
    atomize: str = "Divide the passage into statements that are complete by themselves, figures and names kept. Reply with JSON: {\"data_points\": [statements]}. Passage: {d}"
    abduce: str = "Name one hypothesis that would explain all of these: {items} Reply with JSON: {\"hypothesis\": one sentence, \"why\": one sentence}."


#: A client: (prompt, most tokens of the reply, whether to ask for the JSON mode) to the reply.
Client = Callable[[str, int, bool], str | None]


def asked(call: Client, prompt: str, tokens: int, retries: int, pause: Callable[[float], None]) -> tuple[str | None, str]:
    """The first reply with an object in it, and ``ok`` or the last failure.

    JSON mode is asked for at first only. A reply without an object doubles the budget (1,200 tokens at least) and waits half a
    second longer each time, a fault of the transport a whole one; nothing is waited for after the last try.
    """
    state = "failed: no try"
    for i in range(retries):
        try:
            reply = call(prompt, tokens, i == 0)
        except Exception as e:  # noqa: BLE001 - any transport fault counts
            state = f"failed: {type(e).__name__}: {e}"
            wait = 1.0
        else:
            if reply and "{" in reply:
                return reply, "ok"
            state, wait, tokens = "failed: no object", 0.5, max(2 * tokens, 1_200)
        if i < retries - 1:
            pause(wait * (i + 1))
    return None, state


class RemoteOracle:
    """A remote judge behind the columns of the lexical one. ``connect`` gives each partition its client.

    What every try fails for keeps neutral defaults with a status that is not ok, which the caches do not keep. When nothing has
    succeeded after ``fail_fast`` failures, the task raises with the last failure.
    """

    def __init__(self, model: str, connect: Callable[[], Client], prompts: Prompts | None = None, retries: int = 4, fail_fast: int = 3, pause: Callable[[float], None] = time.sleep):
        self.model, self.connect, self.prompts, self.retries, self.fail_fast, self.pause = model, connect, prompts or Prompts(), retries, fail_fast, pause

    def replies(self, rows: DataFrame, keys: list[str], prompts: dict[str, tuple[F.Column, int]]) -> DataFrame:
        """``rows`` of ``keys`` with the object replied to each prompt, (column, budget) by name, and ``status``: the first failure, or ok."""
        connect, retries, fail_fast, pause, budgets = self.connect, self.retries, self.fail_fast, self.pause, {k: n for k, (_, n) in prompts.items()}
        told = rows.select(*keys, *[c.alias(f"_{k}") for k, (c, _) in prompts.items()])

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call, good, bad = connect(), 0, 0
            for b in batches:
                states = ["ok"] * len(b)
                out = b[keys].copy()
                for k, tokens in budgets.items():
                    found = []
                    for i, prompt in enumerate(b[f"_{k}"]):
                        reply, state = asked(call, prompt, tokens, retries, pause)
                        good, bad = good + (state == "ok"), bad + (state != "ok")
                        if not good and bad >= fail_fast:
                            raise RuntimeError(f"{bad} calls failed and none succeeded; last: {state}")
                        if states[i] == "ok":
                            states[i] = state
                        found.append(reply)
                    out[k] = found
                yield out.assign(status=states)

        schema = ", ".join(f"`{n}` {t}" for n, t in told.select(*keys).dtypes)
        raw = told.mapInPandas(ask, ", ".join([schema, *[f"{k} string" for k in budgets], "status string"]))
        return raw.withColumns({k: text.oracle_json(k) for k in budgets})

    def _filled(self, template: str, **columns: str) -> F.Column:
        out = F.lit(template)
        for mark, c in columns.items():
            out = F.replace(out, F.lit("{" + mark + "}"), F.coalesce(F.col(c), F.lit("")))
        return out

    def priors(self, points: DataFrame) -> DataFrame:
        """(dp_id, prior, status) of ``points(dp_id, dp)``, one call a data point."""
        found = self.replies(points, ["dp_id"], {"r": (self._filled(self.prompts.prior, d="dp"), 400)})
        prior = scale.clamp(scale.safe_double(F.get_json_object("r", "$.prior"), S.DEFAULT_PRIOR), S.PRIOR_RANGE)
        return found.select("dp_id", prior.alias("prior"), _state("r").alias("status"))

    def cells(self, pairs: DataFrame) -> DataFrame:
        """The columns of ``Oracle.cells``: two calls a pair, and one a data point unless the pairs bring a ``prior``."""
        found = self.replies(pairs, ["hyp_id", "dp_id"], {"rel": (self._filled(self.prompts.relatedness, h="hyp", d="dp"), 400), "r": (self._filled(self.prompts.change, h="hyp", d="dp"), 600)})
        known = pairs.select("dp_id", "prior", F.lit("ok").alias("prior_status")).dropDuplicates(["dp_id"]) if "prior" in pairs.columns else self.priors(pairs.select("dp_id", "dp").dropDuplicates(["dp_id"])).withColumnRenamed("status", "prior_status")
        field = lambda c, k: F.get_json_object(c, f"$.{k}")
        status = F.when(_state("r") != "ok", _state("r")).when(_state("rel") != "ok", _state("rel")).otherwise(F.col("prior_status"))
        return found.join(known, "dp_id").select(
            "hyp_id", "dp_id", scale.change_label(field("r", "change")).alias("change"), "prior",
            scale.clamp(scale.safe_double(field("rel", "relatedness"), 0.0), (0.0, 1.0)).alias("relatedness"), F.coalesce(field("r", "why"), F.lit("")).alias("rationale"), status.alias("status"),
        )

    def joint(self, sets: DataFrame) -> DataFrame:
        """(hyp_id, set_key, change, lift, why, status) of ``sets(hyp_id, hyp, set_key, members array, prior)``; ``prior`` is the least of the members'."""
        listed = sets.withColumn("_items", F.array_join(F.transform("members", lambda m: F.concat(F.lit("- "), m)), "\n"))
        found = self.replies(listed, ["hyp_id", "set_key", "prior"], {"r": (self._filled(self.prompts.joint, h="hyp", items="_items"), 250)})
        change = scale.change_label(F.get_json_object("r", "$.change"))
        return found.select("hyp_id", "set_key", change.alias("change"), scale.lift_of_change(change, "prior").alias("lift"), F.coalesce(F.get_json_object("r", "$.why"), F.lit("")).alias("why"), _state("r").alias("status"))

    def atoms(self, chunks: DataFrame) -> DataFrame:
        """(doc_id, chunk_id, ord, pos, text) of ``chunks(doc_id, chunk_id, ord, text)``: the statements of each passage that are long enough, each once."""
        found = self.replies(chunks, ["doc_id", "chunk_id", "ord"], {"r": (self._filled(self.prompts.atomize, d="text"), 2_500)})
        told = F.from_json(F.get_json_object("r", "$.data_points"), "array<string>")
        return found.select("doc_id", "chunk_id", "ord", F.posexplode(text.kept_atoms(F.filter(told, lambda t: t.isNotNull()))).alias("pos", "text"))

    def proposals(self, clusters: DataFrame) -> DataFrame:
        """(cluster, hypothesis, why, status) of ``clusters(cluster, members array)``."""
        listed = clusters.withColumn("_items", F.array_join(F.transform("members", lambda m: F.concat(F.lit("- "), m)), "\n"))
        found = self.replies(listed, ["cluster"], {"r": (self._filled(self.prompts.abduce, items="_items"), 600)})
        return found.select("cluster", F.trim(F.coalesce(F.get_json_object("r", "$.hypothesis"), F.lit(""))).alias("hypothesis"), F.coalesce(F.get_json_object("r", "$.why"), F.lit("")).alias("why"), _state("r").alias("status"))


def _state(reply: str) -> F.Column:
    return F.when(F.col(reply).isNull(), F.when(F.col("status") == "ok", "failed: no object").otherwise(F.col("status"))).otherwise("ok")


def failures(judged: DataFrame, most: int = 8) -> DataFrame:
    """(ok, failed, degraded, errors) of judged rows with a ``status``: what a caller must know before it trusts neutral cells."""
    bad = F.col("status") != "ok"
    sample = judged.where(bad).select("status").dropDuplicates().orderBy("status").limit(most).agg(F.array_sort(F.collect_list("status")).alias("errors"))
    counts = judged.agg(F.count_if(~bad).alias("ok"), F.count_if(bad).alias("failed"))
    return counts.select("ok", "failed", (F.col("failed") > 0).alias("degraded")).join(sample, how="cross")  # one row each


def finished(judged: DataFrame, model: str) -> DataFrame:
    """Cells from judged pairs: multiplier, log lift and verdict."""
    lift = scale.lift_of_change("change", "prior")
    out = judged.withColumn("lift", lift).withColumn("log_lift", F.ln("lift")).withColumn("model", F.lit(model))
    return out.withColumn("verdict", scale.verdict("log_lift"))


def cached_cells(lift_cache: DataFrame) -> DataFrame:
    """One cell per key of the cache table: the one scored last. Labels are normalised and verdicts derived anew."""
    rows = lift_cache.where("hyp_id is not null and dp_id is not null and model is not null")
    one = last_written(rows.select(*CELL_KEY, "change", "lift", "log_lift", "relatedness", "scored_at"), CELL_KEY, ["scored_at"])
    return one.select(*CELL_KEY, scale.change_label("change").alias("change"), "lift", "log_lift", "relatedness", scale.verdict("log_lift").alias("verdict"), "scored_at")


def misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Wanted keys (hyp_id, dp_id, model) that the cache does not hold."""
    return wanted.select(CELL_KEY).dropDuplicates().join(cache.select(CELL_KEY).dropDuplicates(), CELL_KEY, "left_anti")


def grid(hyps: DataFrame, points: DataFrame, oracle: Oracle, cache: DataFrame | None = None) -> DataFrame:
    """Cells of every hypothesis with every data point; cached ones are not judged again.

    Hypotheses are few (``hyps`` is the smaller side by nature); the pairs are the wanted result, not a detour.
    """
    told = points.select("dp_id", F.col("text").alias("dp"))
    # a data point's prior is asked for once, whatever the number of hypotheses
    priced = told.join(oracle.priors(told).where("status = 'ok'").select("dp_id", "prior"), "dp_id", "left").withColumn("prior", F.coalesce("prior", F.lit(S.DEFAULT_PRIOR)))
    pairs = priced.join(hyps.select("hyp_id", F.col("text").alias("hyp")), how="cross")
    columns = [*CELL_KEY, "change", "lift", "log_lift", "relatedness", "verdict", "status"]
    if cache is None:
        return finished(oracle.cells(pairs), oracle.model).select(columns)
    held = cache.where(F.col("model") == oracle.model)
    new = finished(oracle.cells(pairs.join(held.select("hyp_id", "dp_id"), ["hyp_id", "dp_id"], "left_anti")), oracle.model)
    old = held.join(hyps.select("hyp_id"), "hyp_id", "left_semi").join(points.select("dp_id"), "dp_id", "left_semi").withColumn("status", F.lit("ok"))
    return new.select(columns).unionByName(old.select(columns))


def lexical_cells(hyps: DataFrame, points: DataFrame) -> DataFrame:
    """The lexical cells that are not neutral, (hyp_id, dp_id, overlap, neg, change), by an inverted index.

    A pair without a common token is ``unchanged``, so the equi-join over tokens yields all others; the counts of
    neutral cells follow by subtraction.
    """
    h = hyps.select("hyp_id", text.oracle_tokens("text").alias("toks")).select("hyp_id", F.size("toks").alias("nh"), F.explode("toks").alias("tok"))
    d = points.select("dp_id", text.oracle_tokens("text").alias("toks"), text.negative("text").alias("neg"))
    d = d.select("dp_id", "neg", F.size("toks").alias("nd"), F.explode("toks").alias("tok"))
    shared = d.join(h, "tok").groupBy("hyp_id", "dp_id", "neg", "nh", "nd").agg(F.count("*").alias("both"))
    scored = shared.withColumn("overlap", F.col("both") / (F.col("nh") + F.col("nd") - F.col("both")))
    return scored.select("hyp_id", "dp_id", F.round("overlap", 6).alias("overlap"), "neg", text.lexical_change("overlap", "neg").alias("change")).where("change <> 'unchanged'")


def lexical_lifts(hyps: DataFrame, points: DataFrame) -> DataFrame:
    """(hyp_id, dp_id, model, log_lift, verdict): the lexical cells of ``hyps`` and ``points`` that are not neutral."""
    # the lexical oracle never answers ``guaranteed``, so no cell depends on a prior
    lift = scale.lift_of_change("change", F.lit(S.DEFAULT_PRIOR))
    cells = lexical_cells(hyps, points).select("hyp_id", "dp_id", F.lit(LexicalOracle.model).alias("model"), F.ln(lift).alias("log_lift"))
    return cells.withColumn("verdict", scale.verdict("log_lift"))


def lexical_scores(hyps: DataFrame, points: DataFrame) -> DataFrame:
    """Every hypothesis against every data point, answered from the cells that are not neutral: (hyp_id, score, n, n_supporting, n_contradicting, n_neutral, verdict).

    ``points(dp_id, text, cred)``. Neutral cells add nothing to a sum and are counted by subtraction, so the grid is never made.
    """
    total = points.agg(F.count("*").alias("n"))
    sums = lexical_lifts(hyps, points).join(points.select("dp_id", "cred"), "dp_id").groupBy("hyp_id").agg(
        F.sum(F.col("log_lift") * F.col("cred")).alias("score"), F.count_if(scale.supports("verdict")).alias("n_supporting"), F.count_if(scale.contradicts("verdict")).alias("n_contradicting")
    )
    zero = F.lit(0).cast("long")
    rows = hyps.select("hyp_id").join(sums, "hyp_id", "left").join(total, how="cross")  # one row of total
    filled = rows.select("hyp_id", F.coalesce("score", F.lit(0.0)).alias("score"), "n", F.coalesce("n_supporting", zero).alias("n_supporting"), F.coalesce("n_contradicting", zero).alias("n_contradicting"))
    mean = F.round(F.col("score") / F.greatest("n", F.lit(1)), 9)
    return filled.select("*", (F.col("n") - F.col("n_supporting") - F.col("n_contradicting")).alias("n_neutral"), scale.verdict(mean).alias("verdict"))


def lexical_diagnosticity(hyps: DataFrame, points: DataFrame) -> DataFrame:
    """(dp_id, diagnosticity): the variance of each data point's log lifts over all hypotheses, from sums of those that are not 0."""
    total = hyps.agg(F.count("*").alias("n"))
    sums = lexical_lifts(hyps, points).groupBy("dp_id").agg(F.sum("log_lift").alias("s"), F.sum(F.col("log_lift") * F.col("log_lift")).alias("q"))
    rows = points.select("dp_id").join(sums, "dp_id", "left").join(total, how="cross")  # one row of total
    mean = F.coalesce("s", F.lit(0.0)) / F.greatest("n", F.lit(1))
    return rows.select("dp_id", F.greatest(F.lit(0.0), F.coalesce("q", F.lit(0.0)) / F.greatest("n", F.lit(1)) - mean * mean).alias("diagnosticity"))
