"""Scenario and case files (YAML) as tables, and seeded noise for them."""

from __future__ import annotations

import json
import random
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import stripped
from tessera.plans.settings import DUPLICATE_MARK

EPISODES = "scenario string, pos int, text string, credibility double, source_type string, meta string"
CLAIMS = "scenario string, pos int, text string, context_summary string, surviving boolean, eliminated boolean, expected_verdict string"
CASES = "case_id string, capability string, control boolean, adversarial string, domain string, hypothesis string, given_hypotheses array<string>, refuting_sets array<array<string>>, cluster_members array<string>, missing_hypothesis string"
CASE_POINTS = "case_id string, dp string, text string, role string"
OFF_TOPIC_CREDIBILITY = 0.3


def _yaml(path: Path) -> object:
    import yaml

    return yaml.safe_load(path.read_text(encoding="utf-8"))


def scenario_files(folder: str) -> list[Path]:
    """Files of a folder that are scenarios, in order of name; unreadable ones and other shapes are passed over."""
    found = []
    for p in sorted(Path(folder).glob("*.yaml")):
        try:
            raw = _yaml(p)
        except Exception:  # noqa: BLE001, S112 - a shared folder may hold anything
            continue
        if isinstance(raw, dict) and "episodes" in raw:
            found.append(p)
    return found


def read_scenarios(spark: SparkSession, paths: list[Path] | list[str]) -> tuple[DataFrame, DataFrame]:
    """Episodes and claims. Texts are trimmed; credibility is 1, type CONTEXT and meta empty by default; truths align by position."""
    episodes, claims = [], []
    for path in map(Path, paths):
        raw = _yaml(path)
        assert isinstance(raw, dict)
        name = str(raw.get("name") or path.stem)
        for i, e in enumerate(raw.get("episodes") or []):
            meta = dict(e.get("metadata") or {}) | {"credibility": e.get("credibility", 1.0), "source_type": e.get("source_type", "CONTEXT")}
            episodes.append((name, i, str(e["content"]).strip(), float(e.get("credibility", 1.0)), str(e.get("source_type", "CONTEXT")), json.dumps(meta, default=str)))
        truths = (raw.get("ground_truth") or {}).get("claims") or []
        for i, c in enumerate(raw.get("claims") or []):
            t = truths[i] if i < len(truths) else {}
            claims.append((name, i, str(c["text"]).strip(), str(c.get("context_summary") or "").strip(), bool(t.get("is_surviving_hypothesis", False)), bool(t.get("eliminated", False)), t.get("expected_verdict")))
    return spark.createDataFrame(episodes, EPISODES), spark.createDataFrame(claims, CLAIMS)


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Capability cases and their data points. Planted members are those of the ground truth, whatever the roles say."""
    raw = _yaml(Path(path))
    assert isinstance(raw, list)
    cases, points = [], []
    for c in raw:
        truth = c.get("ground_truth") or {}
        sets = [sorted(map(str, s)) for s in truth.get("refuting_sets") or []]
        cases.append((c["id"], c["capability"], bool(c.get("control", False)), c.get("adversarial"), c.get("domain"), c.get("hypothesis"), [str(h) for h in c.get("given_hypotheses") or []], sets, [str(m) for m in truth.get("cluster_members") or []], truth.get("missing_hypothesis")))
        points += [(c["id"], str(d["id"]), str(d["text"]).strip(), d.get("role")) for d in c.get("data_points") or []]
    return spark.createDataFrame(cases, CASES), spark.createDataFrame(points, CASE_POINTS)


def aligned(claims: DataFrame, truths: DataFrame) -> DataFrame:
    """``claims(scenario, text)`` with what is known of them by their text without white space around it; null where nothing is."""
    known = truths.withColumn("_text", stripped("text")).drop("text").dropDuplicates(["scenario", "_text"])
    return claims.withColumn("_text", stripped("text")).join(known, ["scenario", "_text"], "left").drop("_text")


#: Short names of capabilities.
ALIASES = {"conjunction": "conjunction_refutation", "missing": "missing_hypothesis"}


def cases_of(cases: DataFrame, capability: str = "both", only: str | None = None) -> DataFrame:
    """The cases of a capability (by its name or a short one; ``both`` is all) and, where asked for, of one id."""
    if capability and capability != "both":
        cases = cases.where(F.col("capability") == ALIASES.get(capability, capability))
    return cases.where(F.col("case_id") == only) if only else cases


def case_ids(found: DataFrame, points: DataFrame, column: str = "dp_id") -> DataFrame:
    """``found`` with ``case_dp``: the id that a case file gives a data point, by the ``source`` in the record's meta; null where it has none."""
    named = points.select(F.col("dp_id").alias(column), F.get_json_object("meta", "$.source").alias("case_dp")).dropDuplicates([column])
    return found.join(named, column, "left")


def with_noise(episodes: DataFrame, sentences: list[str], n: int = 4, duplicates: int = 1, seed: int = 0) -> DataFrame:
    """``episodes`` of one scenario and ``n`` off-topic sentences drawn with replacement, and near copies of some episodes."""
    own = episodes.orderBy("pos").collect()  # a scenario is a handful of rows
    rng, added = random.Random(seed), []
    name, at = (own[0]["scenario"], len(own)) if own else ("", 0)
    for i in range(n):
        meta = {"noise": "irrelevant", "idx": i, "credibility": OFF_TOPIC_CREDIBILITY, "source_type": "OTHER"}
        added.append((name, at + i, rng.choice(sentences), OFF_TOPIC_CREDIBILITY, "OTHER", json.dumps(meta)))
    for i in range(duplicates if own else 0):
        e = rng.choice(own)
        meta = {"noise": "duplicate", "idx": i, "credibility": e["credibility"], "source_type": e["source_type"]}
        added.append((name, at + n + i, e["text"] + DUPLICATE_MARK, e["credibility"], e["source_type"], json.dumps(meta)))
    return episodes.unionByName(episodes.sparkSession.createDataFrame(added, EPISODES)) if added else episodes
