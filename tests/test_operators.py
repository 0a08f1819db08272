"""Corpus, matrix, refutation, residual, clustering and store operators against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.vectors import hash_matrix
from tessera.operators import corpus, dense, density, evaluation, matrix, orphans, refute, residual
from tessera.plans.settings import Settings
from tessera.sources import scenario
from tessera.sources import ingest
from tessera.sources.store import MOST_DELTAS, Store, read_sqlite


def rows(df):
    return {tuple(r) for r in df.collect()}


def plain_chunks(sentences, least=1, most=8):
    if len(sentences) <= least:
        return [len(sentences)]
    v = hash_matrix(sentences)
    sims = [round(float(v[i] @ v[i + 1]), 6) for i in range(len(sentences) - 1)]
    cut, out, n = float(np.percentile(sims, 25)), [], 1
    for s in sims:
        if n >= least and (s <= cut or n >= most):
            out.append(n)
            n = 0
        n += 1
    return [*out, n]


@pytest.mark.parametrize(("least", "most"), [(1, 8), (1, 3), (2, 3), (4, 8)])
def test_chunks_match_the_sequential_fold(spark, least, most):
    rng = random.Random(3)
    words = "flour oven mixer shift invoice clerk gauge pump seal night audit label".split()
    docs = [(i, " ".join(" ".join(rng.choice(words) for _ in range(rng.randint(2, 6))).capitalize() + "." for _ in range(rng.randint(1, 30)))) for i in range(25)]
    docs += [(98, ""), (99, None)]
    got = {}
    for r in corpus.chunks_of(spark.createDataFrame(docs, "doc_id long, text string"), Settings(chunk_min_sentences=least, chunk_max_sentences=most)).collect():
        got.setdefault(r.doc_id, {})[r.ord] = r.n_sentences
    from tessera.functions import text

    split = {r[0]: r[1] for r in spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", text.simple_sentences("text")).collect()}
    for i, _ in docs:
        if split[i]:
            assert [got[i][k] for k in sorted(got[i])] == plain_chunks(split[i], least, most), i
    assert 98 not in got and 99 not in got


def test_fold_chunks_respects_a_minimum(spark):
    sims = [0.9, 0.1, 0.8, 0.1, 0.1, 0.9]
    df = spark.createDataFrame([(sims, 0.1)], "s array<double>, t double")
    got = df.select(corpus.fold_chunks(F.col("s"), F.col("t"), Settings(chunk_min_sentences=2, chunk_max_sentences=3))).first()[0]
    assert got == [0, 2, 4]


def test_last_written_and_live(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 3, "y"), ("b", None, "z"), ("b", 2, "w")], "k string, t int, v string")
    assert rows(corpus.last_written(log, ["k"], ["t"])) == {("a", 3, "y"), ("b", 2, "w")}
    gone = spark.createDataFrame([("t", "a", 2), ("t", "b", 9), ("u", "a", 9)], "tbl string, key string, deleted_at int")
    assert rows(corpus.live(log.dropDuplicates(), gone, "t", "k", "t")) == {("a", 3, "y")}


def test_upsert_replaces_by_key(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert rows(corpus.upsert(old, spark.createDataFrame([("b", 5), ("c", 6)], "k string, v int"), ["k"])) == {("a", 1), ("b", 5), ("c", 6)}


CELLS = [("h1", "p1", "m", 1.0, 0.9), ("h1", "p2", "m", -2.0, 0.5), ("h1", "p3", "m", -2.0, 1.0), ("h2", "p1", "m", 0.1, 0.9)]


def test_scores_best_worst_and_diagnosticity(spark):
    from tessera.functions import scale

    cells = spark.createDataFrame(CELLS, "hyp_id string, dp_id string, model string, log_lift double, cred double").withColumn("verdict", scale.verdict("log_lift"))
    s = {r.hyp_id: r for r in matrix.hypothesis_scores(cells).collect()}
    assert math.isclose(s["h1"].score, 0.9 - 1.0 - 2.0) and (s["h1"].n, s["h1"].n_supporting, s["h1"].n_contradicting) == (3, 1, 2)
    assert s["h1"].verdict == "contradicts"  # -2.1 / 3: the sum is weighted, the count is not
    b = {r.hyp_id: r for r in matrix.best_worst(cells).collect()}
    assert (b["h1"].worst_dp, b["h1"].best_dp) == ("p2", "p1")
    d = {r.dp_id: r.diagnosticity for r in matrix.diagnosticity(cells).collect()}
    assert math.isclose(d["p1"], np.var([1.0, 0.1])) and d["p2"] == 0
    assert residual.residuals(cells, 0.15).count() == 0 and residual.residuals(cells.where("hyp_id = 'h2'"), 0.15).count() == 1


# ------------------------------------------------------------------------------------------ refutation
def plain_search(ev, s):
    """The greedy search as a loop over one hypothesis at a time."""
    from tessera.plans.settings import LIFT_OF

    def joint(h, members):
        if len(members) == 1:
            return ev[h, members[0]]["lift"]
        neg, pos = sum(ev[h, m]["neg"] for m in members), sum(ev[h, m]["pos"] for m in members)
        return LIFT_OF["much_less" if neg and pos else "less" if neg else "more" if pos >= 2 else "unchanged"]

    out = set()
    for h in sorted({k[0] for k in ev}):
        pool = sorted(k[1] for k in ev if k[0] == h)
        ranked = sorted(pool, key=lambda d: (ev[h, d]["lift"], d))
        seeds = [d for d in ranked if ev[h, d]["lift"] >= s.refute_lift][: s.seeds] or ranked[: s.seeds]
        seen = set()
        for seed in seeds:
            cur, lift = [seed], ev[h, seed]["lift"]
            while len(cur) < s.set_size:
                ents, toks = {e for m in cur for e in ev[h, m]["ents"]}, {t for m in cur for t in ev[h, m]["toks"]}
                cands = sorted(((-10 * len(ents & set(ev[h, d]["ents"])) - len(toks & set(ev[h, d]["toks"])), d) for d in pool if d not in cur))
                cands = [d for sc, d in cands if sc < 0][: s.shortlist]
                best = min(((joint(h, [*cur, d]), i, d) for i, d in enumerate(cands)), default=None)
                if best is None or best[0] >= lift:
                    break
                cur, lift = [*cur, best[2]], best[0]
                if lift < s.refute_lift:
                    shrunk = True
                    while shrunk and len(cur) > 2:
                        shrunk = False
                        for d in cur:
                            rest = [x for x in cur if x != d]
                            if joint(h, rest) < s.refute_lift:
                                cur, shrunk = rest, True
                                break
                    if frozenset(cur) not in seen:
                        seen.add(frozenset(cur))
                        out.add((h, ",".join(sorted(cur))))
                    break
    return out


def test_refuting_sets_match_the_plain_search(spark):
    rng = random.Random(11)
    data = []
    for h in range(6):
        for d in range(14):
            data.append((f"h{h}", f"d{d:02}", rng.choice([0.1, 0.5, 1.0, 1.0, 2.0]), int(rng.random() < 0.25), int(rng.random() < 0.35), 0.5, [f"e{rng.randint(0, 6)}" for _ in range(2)], [f"t{rng.randint(0, 9)}" for _ in range(3)]))
    ev = spark.createDataFrame([(*r[:6], sorted(set(r[6])), sorted(set(r[7]))) for r in data], "hyp_id string, dp_id string, lift double, neg int, pos int, prior double, ents array<string>, toks array<string>")
    plain = {(r.hyp_id, r.dp_id): r.asDict() for r in ev.collect()}
    s = Settings(shortlist=6)
    found = refute.refuting_sets(ev, s)
    assert {(r.hyp_id, r.set_key) for r in found.collect()} == plain_search(plain, s)
    assert all(r.joint_lift < 0.25 and r.llm_calls > 0 for r in found.collect())


def test_joint_lift_of_none_and_one(spark):
    ev = spark.createDataFrame([("h", "a", 0.5, 0, 0, 0.5)], "hyp_id string, dp_id string, lift double, neg int, pos int, prior double")
    trials = spark.createDataFrame([("h", 1, []), ("h", 2, ["a"])], "hyp_id string, trial int, members array<string>")
    assert {r.trial: r.joint_lift for r in refute.joint_lifts(trials, ev).collect()} == {1: 1.0, 2: 0.5}


# ------------------------------------------------------------------------------------------ clusters
def test_average_linkage_and_coherence():
    rng = np.random.default_rng(0)
    a, b = np.array([1.0, 0, 0]), np.array([0, 1.0, 0])
    v = np.stack([x + 0.05 * rng.normal(size=3) for x in [a] * 5 + [b] * 4] + [np.zeros(3)])
    n = np.linalg.norm(v, axis=1, keepdims=True)
    v = v / np.where(n == 0, 1, n)
    labels = dense.average_linkage(v, 0.6)
    assert len(set(labels[:5])) == 1 and len(set(labels[5:9])) == 1 and labels[0] != labels[5] and labels[9] not in labels[:9]
    pairs = [float(v[i] @ v[j]) for i in range(5) for j in range(5) if i != j]
    assert math.isclose(dense.coherence(v[:5]), np.mean(pairs))


def test_hdbscan_finds_dense_groups_and_noise():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0, 0.05, (15, 2)), rng.normal(3, 0.05, (12, 2)), [[10.0, -9.0]]])
    labels = dense.hdbscan(v, 3)
    assert len(set(labels[:15]) - {-1}) == 1 and len(set(labels[15:27]) - {-1}) == 1 and labels[27] == -1
    assert set(labels[:15]) != set(labels[15:27])
    assert list(dense.hdbscan(v[:2], 3)) == [-1, -1]


def test_pair_statistics_match_all_pairs(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(30, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    lab = [i % 3 for i in range(30)]
    got = {r.label: r for r in dense.pair_statistics(spark.createDataFrame([(int(a), list(map(float, x))) for a, x in zip(lab, v)], "label int, vec array<double>").repartition(5), "label", "vec").collect()}
    d = 1 - v @ v.T
    for p in range(3):
        own, rest = [i for i in range(30) if lab[i] == p], [i for i in range(30) if lab[i] != p]
        pp, pq = [d[i, j] for i in own for j in own if i < j], [d[i, j] for i in own for j in rest]
        assert math.isclose(got[p].mean_pp, np.mean(pp), abs_tol=2e-6) and math.isclose(got[p].var_pp, np.var(pp), abs_tol=2e-6)
        assert math.isclose(got[p].mean_pq, np.mean(pq), abs_tol=2e-6)
        assert math.isclose(got[p].cohen_d, (np.mean(pp) - np.mean(pq)) / -math.sqrt((np.var(pp) + np.var(pq)) / 2), abs_tol=2e-4)


def test_residual_clusters_group_and_skip_small(spark):
    texts = ["pump seal cracked at night", "pump seal cracked by night", "the pump seal cracked at night", "a choir rehearses in the hall"]
    df = spark.createDataFrame([("g", f"d{i}", t) for i, t in enumerate(texts)] + [("s", "x", "alone")], "g string, dp_id string, text string")
    got = residual.clusters(df, "g").collect()
    assert [(r.g, r.dp_ids, r["size"]) for r in got] == [("g", ["d0", "d1", "d2"], 3)]


# ------------------------------------------------------------------------------------------ orphans
def test_orphan_kinds(spark):
    import datetime as dt

    t = lambda d: dt.datetime(2024, 1, d)
    refs = [("a", "k1", t(5)), ("b", "gone", t(5)), ("c", "", t(5)), ("d", None, t(5)), ("e", "late", t(5)), ("f", "late", None), ("g", "back", t(9)), ("h", "dead", t(9)), ("a", "k1", t(5)), ("i", "late", t(8)), ("j", "never", None)]
    tables = {
        "r": spark.createDataFrame([(*x, "extra") for x in refs], "id string, v string, t timestamp_ntz, kind string"),
        "p": spark.createDataFrame([("k1", t(1)), ("late", t(7)), ("back", t(8)), ("dead", t(2)), ("dead", t(3))], "v string, t timestamp_ntz"),
        "tombstones": spark.createDataFrame([("p", "back", t(6)), ("p", "dead", t(3)), ("p", "gone", t(1)), ("q", "k1", t(9))], "tbl string, key string, deleted_at timestamp_ntz"),
    }
    ref = orphans.Reference("r", "v", ("id",), "t", "p", "v", "t")
    got = {(r.row_key, r.ref_value, r.kind) for r in orphans.orphans(tables, (ref,)).collect()}
    assert got == {("b", "gone", "deleted"), ("e", "late", "late"), ("h", "dead", "deleted"), ("j", "never", "missing")}
    empty = {k: v.limit(0) for k, v in tables.items()}
    assert orphans.orphans(empty, (ref,)).count() == 0
    assert orphans.orphans({**tables, "p": tables["p"].limit(0)}, (ref,)).where("kind = 'missing'").count() > 0


def test_orphans_with_a_hot_key(spark):
    hot = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("v"), F.lit(None).cast("timestamp_ntz").alias("t"))
    tables = {"r": hot, "p": hot.where("v <> 'hot'").select("v", "t"), "tombstones": spark.createDataFrame([], "tbl string, key string, deleted_at timestamp_ntz")}
    got = orphans.orphans(tables, (orphans.Reference("r", "v", ("id",), "t", "p", "v", "t"),))
    assert got.count() == 6667 and got.select("kind").distinct().collect()[0][0] == "missing"


# ------------------------------------------------------------------------------------------ evaluation, sources
def test_scenario_files_and_noise(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("name: A\nepisodes:\n- content: ' one '\n  metadata: {date: 2024-01-02}\n- content: two\n  credibility: 0.5\nclaims:\n- text: ' c1 '\n- text: c2\nground_truth:\n  claims:\n  - is_surviving_hypothesis: true\n")
    (tmp_path / "b.yaml").write_text("- id: x\n  capability: conjunction_refutation\n  data_points: [{id: d1, text: ' t ', role: cluster_member}]\n  ground_truth: {refuting_sets: [[d2, d1]]}\n")
    (tmp_path / "c.yaml").write_text("{broken")
    files = scenario.scenario_files(str(tmp_path))
    assert [f.name for f in files] == ["a.yaml"]
    ep, cl = scenario.read_scenarios(spark, files)
    assert [(r.text, r.credibility, r.source_type) for r in ep.orderBy("pos").collect()] == [("one", 1.0, "CONTEXT"), ("two", 0.5, "CONTEXT")]
    assert [(r.text, r.surviving, r.eliminated) for r in cl.orderBy("pos").collect()] == [("c1", True, False), ("c2", False, False)]
    cases, points = scenario.read_cases(spark, str(tmp_path / "b.yaml"))
    assert cases.first().refuting_sets == [["d1", "d2"]] and points.first().text == "t"
    noisy = scenario.with_noise(ep, ["x", "y"], n=4, duplicates=2, seed=7)
    assert noisy.count() == 8 and rows(noisy) == rows(scenario.with_noise(ep, ["x", "y"], n=4, duplicates=2, seed=7))
    assert noisy.where("credibility = 0.3").count() == 4


def test_store_versions_merge_and_clear(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert s.read("hypotheses").count() == 0
    s.merge("hypotheses", spark.createDataFrame([("h", "a", "", "{}")], "hyp_id string, text string, context_summary string, meta string"))
    s.merge("hypotheses", spark.createDataFrame([("h", "b", "", "{}"), ("i", "c", "", "{}")], "hyp_id string, text string, context_summary string, meta string"))
    assert {(r.hyp_id, r.text) for r in s.read("hypotheses").collect()} == {("h", "b"), ("i", "c")}
    s.merge("prior_cache", spark.createDataFrame([("d", "m", 0.5)], "dp_id string, model string, prior double"))
    s.clear_corpus()
    assert s.read("hypotheses").count() == 0 and s.read("prior_cache").count() == 1
    s.clear_all()
    assert s.read("prior_cache").count() == 0


def test_store_folds_merges_into_a_version(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    schema = "dp_id string, model string, prior double"
    for k in range(MOST_DELTAS + 3):
        s.merge("prior_cache", spark.createDataFrame([("d", "m", float(k)), (f"e{k}", "m", 0.5)], schema))
    assert s._state("prior_cache") == (1, 2)
    got = {r.dp_id: r.prior for r in s.read("prior_cache").collect()}
    assert len(got) == MOST_DELTAS + 4 and got["d"] == MOST_DELTAS + 2
    failed = spark.createDataFrame([("h", "d", "m", "more", 2.0, 0.7, 0.1, "supports", "", "failed: x")], "hyp_id string, dp_id string, model string, change string, lift double, log_lift double, relatedness double, verdict string, rationale string, status string")
    s.merge("lift_cache", failed)
    assert s.read("lift_cache").count() == 0


def test_sqlite_scan(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "x.db")
    con = sqlite3.connect(path)
    con.execute("create table t (id text, n integer, x real)")
    con.executemany("insert into t values (?, ?, ?)", [(str(i), i, i / 2) for i in range(100)])
    con.commit()
    con.close()
    df = read_sqlite(spark, path, "t", splits=3)
    assert df.count() == 100 and df.agg(F.sum("n"), F.sum("x")).first()[:] == (4950, 2475.0)


def test_ingest(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    rows_of = lambda data: spark.createDataFrame(data, "name string, text string, meta string")
    text = "The pump seal cracked at night. The choir sang in the hall. The pump seal was replaced by the clerk."
    for _ in range(2):  # the same again changes nothing
        got = {r.doc_id: r.n_data_points for r in ingest.add_documents(s, rows_of([("a", text, '{"source": "desk"}'), ("b", "", None), (None, "x", None)])).collect()}
    assert sorted(got.values()) == [0, 3] and s.read("documents").count() == 2 and s.read("data_points").count() == 3
    doc = s.read("documents").where("name = 'a'").first().doc_id
    assert matrix.points_of(s.read("data_points").withColumn("written_at", F.lit(0)), F.lit(doc)).count() == 3
    assert rows(s.read("data_points").select("meta")) == {('{"source": "desk"}',)} and s.read("chunks").count() >= 1
    ep = spark.createDataFrame([(" One claim only. ", '{"source": "d7"}'), (None, None)], "text string, meta string")
    assert rows(ingest.add_episodes(s, ep, atomize=False).select("n_data_points")) == {(1,)}
    one = s.read("data_points").where("chunk_id like 'chunk::%'").first()
    assert one.text == "One claim only." and one.doc_id.startswith("doc::") and len(one.doc_id) == 13
    assert ingest.add_episodes(s, ep).count() == 1
    assert rows(scenario.case_ids(spark.createDataFrame([(one.dp_id,), ("zz",)], "dp_id string"), s.read("data_points")).select("case_dp")) == {("d7",), (None,)}
    hyps = ingest.add_hypotheses(s, spark.createDataFrame([(" H one. ", " c ", None), ("H two.", None, "{}")], "text string, context_summary string, meta string"))
    assert hyps.count() == 2 and s.read("hypotheses").where("text = 'H one.' and context_summary = 'c' and meta = '{}'").count() == 1
    yaml = tmp_path / "s.yaml"
    yaml.write_text("name: n\nepisodes:\n  - content: The log was altered.\nclaims:\n  - text: Someone altered it.\n")
    assert ingest.load_scenario(s, [yaml], 0) == (1, 1)
    with pytest.raises(IndexError):
        ingest.load_scenario(s, [yaml], 1)


def test_answers_for_one_hypothesis_and_at_the_ends(spark):
    cells = spark.createDataFrame([("h1", "a", "m", 1.0, 2.7), ("h1", "b", "m", -0.5, 0.6), ("h2", "a", "m", -2.0, 0.14), ("h2", "b", "m", -1.0, 0.37)], "hyp_id string, dp_id string, model string, log_lift double, lift double").withColumn("verdict", F.lit("neutral")).withColumn("cred", F.lit(1.0)).withColumn("change", F.lit("more")).withColumn("relatedness", F.lit(0.5))
    points = spark.createDataFrame([("a", 1, "text a", '{"source": "s", "noise": "duplicate"}', 1), ("b", 1, "text b", None, 1)], "dp_id string, doc_id long, text string, meta string, written_at int")
    results = matrix.hypothesis_scores(cells)
    assert rows(matrix.report_ends(results, cells, points)) == {("m", "top", "h1", "a", "text a"), ("m", "bottom", "h2", "a", "text a")}
    assert rows(matrix.by_score(results).select("hyp_id", "rank")) == {("h1", 1), ("h2", 2)}
    assert matrix.of_hypothesis(cells, "h1").count() == 2
    with pytest.raises(LookupError):
        matrix.of_hypothesis(cells, "h9")
    lines = matrix.points_json(matrix.point_rows(cells, points)).collect()
    assert len(lines) == 2 and any('"noise":"duplicate"' in r.json for r in lines)
    assert matrix.matrix_json(cells, results).where("kind = 'cell' and json like '%\"lift\":2.7%'").count() == 1
    sets = spark.createDataFrame([("h2", "a,b", ["a", "b"], 0.2, True, 3)], "hyp_id string, set_key string, members array<string>, joint_lift double, conjunction_only boolean, llm_calls int")
    line = matrix.refutations_json(sets, points, cells).first().json
    assert '"size":2' in line and '"member_lifts":{"a":0.14,"b":0.37}' in line and '"data_points":["text a","text b"]' in line
    found = spark.createDataFrame([(0, ["a"], 1, 0.5, "H", 1.0, True)], "cluster int, dp_ids array<string>, size int, coherence double, hypothesis string, explained double, admitted boolean")
    assert '"abduced_hypothesis":"H"' in matrix.residuals_json(found).first().json


def test_case_filters_and_measures(spark):
    cases = spark.createDataFrame([("c1", "conjunction_refutation", False), ("c2", "missing_hypothesis", True), ("c3", "missing_hypothesis", True)], "case_id string, capability string, control boolean")
    assert scenario.cases_of(cases).count() == 3 and scenario.cases_of(cases, "missing").count() == 2 and scenario.cases_of(cases, "both", "c1").count() == 1
    found = spark.createDataFrame([("c2", False), ("c1", True), ("c1", False)], "case_id string, conjunction_only boolean")
    assert rows(evaluation.control_findings(cases, found)) == {("c2", 1, False), ("c3", 0, True)}
    assert rows(evaluation.conjunction_found(found)) == {("c1", True), ("c2", False)}
    planted = spark.createDataFrame([("c1", ["a", "b"]), ("c1", ["b", "c"])], "case_id string, members array<string>")
    assert rows(evaluation.member_recall(planted, spark.createDataFrame([("c1", "b"), ("c1", "z")], "case_id string, dp_id string"))) == {("c1", 0.333333)}


def test_markers_of_a_source_tree(spark, tmp_path):
    from tessera.sources.markers import marked

    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("X = 1\n\nclass C:\n    def one(self):\n        y = 2\n\n        return 'alpha'\n\n    def two(self):\n        return 'beta'\n")
    got = {(r.file, r.function, r.marker): r.found for r in marked(spark, str(tmp_path), [("a.py", None, "beta"), ("a.py", "one", "alpha"), ("a.py", "one", "beta"), ("a.py", "two", "beta"), ("b.py", None, "x")]).collect()}
    assert got == {("a.py", None, "beta"): True, ("a.py", "one", "alpha"): True, ("a.py", "one", "beta"): False, ("a.py", "two", "beta"): True, ("b.py", None, "x"): False}


def test_truths_align_by_text(spark):
    claims = spark.createDataFrame([("s", " One. "), ("s", "Two.")], "scenario string, text string")
    truths = spark.createDataFrame([("s", "One.\n", True), ("t", "Two.", True)], "scenario string, text string, surviving boolean")
    assert rows(scenario.aligned(claims, truths).select("text", "surviving")) == {(" One. ", True), ("Two.", None)}


def test_hypotheses_beyond_one_block_are_compared(spark, monkeypatch):
    hyps = spark.createDataFrame([(f"h{i}", f"word{i} alone") for i in range(40)], "hyp_id string, text string")
    points = spark.createDataFrame([(f"d{i}", f"word{i * 7} here") for i in range(12)], "dp_id string, text string")
    whole = rows(residual.retrieval_baseline(hyps, points))
    monkeypatch.setattr(residual, "SIDE_ROWS", 6)
    assert rows(residual.retrieval_baseline(hyps, points)) == whole and len(whole) == 4


def test_sparse_tfidf_is_the_dense_one(spark):
    from tessera.functions import vectors

    texts = ["the pump seal cracked", "the pump seal seal", "choir night", ""]
    dense_rows = vectors.tfidf_matrix(texts)
    names = sorted({w for t in texts for w in t.split()})
    for r in vectors.sparse_tfidf(spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "g int, i int, t string"), "g", ["i"], "t").collect():
        assert abs(dense_rows[r.i, names.index(r.term)] - r.weight) < 1e-9


def test_arrivals_are_scored_once(spark, tmp_path):
    from tessera.operators.scoring import LexicalOracle
    from tessera.streaming.incremental import score_arrivals

    s = Store(spark, str(tmp_path / "store"))
    s.write("hypotheses", spark.createDataFrame([("h", "the pump seal cracked", "", "{}")], "hyp_id string, text string, context_summary string, meta string"))
    feed = str(tmp_path / "feed")
    schema = "dp_id string, text string"
    for k in range(2):
        spark.createDataFrame([("d1", "the pump seal cracked at night"), (f"e{k}", "a choir sang")], schema).write.mode("append").parquet(feed)
        score_arrivals(spark.readStream.schema(schema).parquet(feed), s, LexicalOracle(), str(tmp_path / "ckpt")).awaitTermination()
    assert rows(s.read("lift_cache").select("dp_id", "change")) == {("d1", "much_more"), ("e0", "unchanged"), ("e1", "unchanged")}


def test_evaluation_measures(spark):
    p = spark.createDataFrame([("c", ["a", "b"])], "case_id string, members array<string>")
    f = spark.createDataFrame([("c", 0, ["a"]), ("c", 1, ["a", "b", "x"])], "case_id string, pos int, members array<string>")
    assert evaluation.set_recall(p, f.drop("pos")).first().recall == 1.0
    best = evaluation.cluster_recall(p, f).first()
    assert (best.recall, best.purity) == (1.0, 0.666667)
    assert evaluation.ladder(0.1, 0.8)[0] == 0.07 and len(evaluation.ladder(0.1, 0.8)) == 15


@pytest.mark.parametrize("name", ["p3_found", "hypothesis_scores", "best_worst_cells", "semantic_chunks", "refutation_seeds", "set_recall"])
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import glob
    import os

    from tessera.plans import catalog

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    con = duckdb.connect()
    for path in glob.glob(folder + "/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = catalog.queries()[name](spark, folder)
    columns = sorted(df.columns)
    norm = lambda rs: sorted(tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rs)
    got = norm([tuple(r) for r in df.select(*columns).collect()])
    want = norm(con.sql(f"select {', '.join(f'\"{c}\"' for c in columns)} from ({catalog.oracle_sql()[name]})").fetchall())
    assert got == want


def test_ranks_of_a_group_that_spans_partitions(spark):
    from tessera.operators.ranking import first_k, ranked

    rng = random.Random(8)
    data = [("hot" if i % 3 else f"g{i % 7}", rng.randint(0, 50), i) for i in range(900)] + [(None, 1, 9_000), (None, 1, 9_001)]
    df = spark.createDataFrame(data, "g string, v int, i int").repartition(6)
    order = [F.desc("v"), F.asc("i")]
    want = {}
    for g in {x[0] for x in data}:
        for k, x in enumerate(sorted((x for x in data if x[0] == g), key=lambda x: (-x[1], x[2]))):
            want[x[2]] = k + 1
    assert {r.i: r["rank"] for r in ranked(df, ["g"], order).collect()} == want
    assert {r.i: r["rank"] for r in first_k(df, ["g"], order, 5).collect()} == {i: k for i, k in want.items() if k <= 5}
    whole = {r.i: r["rank"] for r in ranked(df, [], order).collect()}
    assert whole == {x[2]: k + 1 for k, x in enumerate(sorted(data, key=lambda x: (-x[1], x[2])))}
    assert ranked(df.limit(0), ["g"], order).count() == 0


def test_large_groups_are_clustered_in_slices(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    topics = [rng.sample(words, 6) for _ in range(8)]
    df = spark.createDataFrame([("g", f"d{i:03}", " ".join(topics[i % 8])) for i in range(160)], "g string, dp_id string, text string")
    got = residual.clusters(df, "g", whole_below=40).collect()
    assert sum(r["size"] for r in got) >= 150 and len({r.cluster for r in got}) == len(got)
    assert all(len({int(d[1:]) % 8 for d in r.dp_ids}) == 1 for r in got)


def test_density_over_blocks_equals_one_matrix(spark):
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(c, 0.4, (40, 5)) for c in (0, 2, 4)] + [rng.normal(0, 6, (30, 5))])
    v = np.concatenate([v, v[:4], v[:2], v[:2]])
    labels = dense.hdbscan(v, 3)
    df = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(v)], "g int, i int, vec array<double>")
    rows = density.labelled(density.coded(df, "g", "i", "vec", lambda xs: np.stack(xs)), "g", "i", 3, tile=16).collect()
    got = {r.i: r.cluster for r in rows}
    same = lambda f: {frozenset(i for i in range(len(v)) if f(i) == c) for c in {f(i) for i in range(len(v))} - {-1}}
    assert len(rows) == len(v) and same(lambda i: labels[i]) == same(got.get) and len(set(labels)) > 3


def test_clusters_of_a_large_group_are_those_of_the_whole(spark):
    rng = np.random.default_rng(6)
    v = np.round(np.concatenate([rng.normal(c, 0.4, (40, 5)) for c in (0, 2, 4)] + [rng.normal(0, 6, (30, 5))]), 9)
    df = spark.createDataFrame([("g", f"d{i:03}", " ".join(map(repr, x.tolist()))) for i, x in enumerate(v)], "g string, dp_id string, text string")
    got = residual.clusters(df, "g", encode=lambda texts: np.array([[float(x) for x in t.split()] for t in texts]), whole_below=20).collect()
    labels = dense.hdbscan(v, 3)
    assert sorted(r.dp_ids for r in got) == sorted([f"d{i:03}" for i in np.flatnonzero(labels == c)] for c in set(labels) - {-1})


def test_residual_clusters_are_sought_over_all_documents(spark, tmp_path):
    import datetime as dt

    from tessera.plans import lift_queries

    texts = ["pump seal cracked at night", "pump seal cracked by night", "the pump seal cracked at night", "a pump seal cracked at night", "a choir rehearses in the hall"]
    at = dt.datetime(2024, 1, 1)
    points = [(f"d{i}", None if i == 3 else i, t, at) for i, t in enumerate(texts)]
    spark.createDataFrame(points, "dp_id string, doc_id long, text string, written_at timestamp").write.parquet(f"{tmp_path}/data_points.parquet")
    cells = [("h", f"d{i}", "unchanged", 1.0, 0.0, "neutral", "m", 0.5, at) for i in range(5)]
    spark.createDataFrame(cells, "hyp_id string, dp_id string, change string, lift double, log_lift double, verdict string, model string, relatedness double, scored_at timestamp").write.parquet(f"{tmp_path}/lift_cache.parquet")
    assert [r.dp_ids for r in lift_queries.residual_clusters(spark, str(tmp_path)).collect()] == [["d0", "d1", "d2", "d3"]]
    got = lift_queries.missing_hypotheses(spark, str(tmp_path)).collect()
    assert [r["size"] for r in got] == [4] and "pump" in got[0].hypothesis


def test_density_clusters_span_all_vectors(spark, tmp_path):
    from tessera.plans import eval_queries

    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(c, 0.1, (120, 4)) for c in (0, 5)])[np.arange(240) % 2 * 120 + np.arange(240) // 2]
    spark.createDataFrame([(i, x.tolist(), i % 2) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    sizes = Counter(dense.hdbscan(v.astype(np.float32).astype(float), 3).tolist())
    got = eval_queries.density_clusters(spark, str(tmp_path)).collect()
    assert sorted(r["size"] for r in got) == sorted(sizes.values())


def _tree_over_blocks(v, blocks, k, monkeypatch):
    """(weights of the lightest tree, share of pairs compared, parts between which edges were sought) by the steps of ``density.labelled``."""
    near, seen = 2 * k, [0]
    found = density._near

    def counted(*args):
        for rows, leaf, d in found(*args):
            seen[0] += d.size
            yield rows, leaf, d

    monkeypatch.setattr(density, "_near", counted)
    at = density.placed(v, density.plan(v, blocks), np.array([f"{i:08x}" for i in range(len(v))]))
    ids = [np.flatnonzero(at == b) for b in range(blocks) if (at == b).any()]
    ids = [i[density._ordered(v[i].astype(np.float32))] for i in ids]
    own, lists, radii = [density._Block(v[i]) for i in ids], [[] for _ in ids], []
    for x, b in enumerate(own):
        first = density._first_radius(b, near)
        i, j, d = density._neighbours(b, b, True, first, first)
        i, j, d = np.r_[i, j], np.r_[j, i], np.r_[d, d]
        radii.append(density._radius(len(b.x), i, d, near))
        lists[x].append((i, ids[x][j], d))
    for x in range(len(own)):
        for y in range(x + 1, len(own)):
            i, j, d = density._neighbours(own[x], own[y], False, *((r * r).astype(np.float32) for r in (radii[x], radii[y])))
            lists[x].append((i, ids[y][j], d))
            lists[y].append((j, ids[x][i], d))
    core, radius, a, b, d = np.zeros(len(v)), np.zeros(len(v)), [], [], []
    for x, own_lists in enumerate(lists):
        i, o, w = (np.concatenate(c) for c in zip(*own_lists, strict=True))
        radius[ids[x]] = r = density._radius(len(ids[x]), i, w, near)
        core[ids[x]] = density._core(np.ones(len(ids[x]), int), i, w, np.ones(len(i), int), k)
        a, b, d = a + [ids[x][i[w <= r[i]]]], b + [o[w <= r[i]]], d + [w[w <= r[i]]]
    a, b, d = (np.concatenate(c) for c in (a, b, d))
    w = np.maximum(d, np.maximum(core[a], core[b]))
    e = density.forest_of(np.minimum(a, b), np.maximum(a, b), w)
    a, b, w = np.minimum(a, b)[e], np.maximum(a, b)[e], w[e]
    _, part, limits = density.parted(len(v), a, b, w, radius)
    edges = [(a, b, w)]
    ids = [i[np.argsort(part[i], kind="stable")] for i in ids]
    own = [density._Block(v[i]) for i in ids]
    for x in range(len(own)):
        for y in range(x, len(own)):
            i, j, s = density._between(own[x], own[y], x == y, (part[ids[x]], part[ids[y]]), (core[ids[x]], core[ids[y]]), limits)
            edges.append((ids[x][i], ids[y][j], s))
    a, b, w = (np.concatenate(c) for c in zip(*edges, strict=True))
    return w[density.forest_of(a, b, w)], seen[0] / len(v) ** 2, len(np.unique(part))


def test_the_lightest_tree_of_all_pairs_comes_from_few_of_them(monkeypatch):
    rng = np.random.default_rng(21)
    words = rng.dirichlet(np.full(256, 0.05), 40)
    counts = np.stack([rng.multinomial(9, words[i % 40]) + rng.multinomial(4, np.full(256, 1 / 256)) for i in range(2_000)]).astype(float)
    v = np.unique(counts / np.linalg.norm(counts, axis=1, keepdims=True), axis=0)
    d = np.sqrt(np.maximum(2 - 2 * v @ v.T, 0))
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, 2]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    near, inside, at, whole = np.full(len(v), np.inf), np.zeros(len(v), bool), 0, []
    for _ in range(len(v) - 1):
        inside[at] = True
        near = np.minimum(near, reach[at])
        at = int(np.where(inside, np.inf, near).argmin())
        whole.append(near[at])
    w, share, parts = _tree_over_blocks(v, 5, 3, monkeypatch)
    assert parts > 1 and share < 0.25 and len(w) == len(whole) and np.allclose(np.sort(w), np.sort(whole), atol=1e-7)
    monkeypatch.setattr(density, "PARTS", 1)
    assert np.allclose(np.sort(_tree_over_blocks(v, 5, 3, monkeypatch)[0]), np.sort(whole), atol=1e-7)


def test_vectors_too_sparse_for_an_edge_are_not_compared(monkeypatch):
    rng = np.random.default_rng(22)
    v = np.concatenate([rng.normal(c, 0.1, (150, 6)) for c in (0, 1.5)] + [rng.uniform(-30, 30, (300, 6))])
    part, seen, near = np.repeat([0, 1, 2], [150, 150, 300]), [], density._near

    def counted(*args):
        for rows, leaf, d in near(*args):
            seen.append(len(args[0].v))
            yield rows, leaf, d

    monkeypatch.setattr(density, "_near", counted)
    b, core, limits = density._Block(v), np.where(part == 2, 20.0, 0.2), np.where(np.eye(3) > 0, -1.0, 9.0)
    i, j, w = density._between(b, b, True, (part, part), (core, core), limits)
    d = np.sqrt(((v[:150, None] - v[None, 150:300]) ** 2).sum(axis=2))
    assert set(seen) == {300} and np.allclose(w, d.min()) and {part[i[0]], part[j[0]]} == {0, 1}


def test_counts_are_compared_as_their_vectors():
    rng = np.random.default_rng(23)
    words = [f"w{i}" for i in range(300)]
    sets = [rng.choice(words, 9, replace=False).tolist() for _ in range(12)]
    texts = [" ".join([*sets[i % 12], *rng.choice(words, 5), *(["pump"] * (i % 4))]) for i in range(700)]
    v = np.unique(np.round(hash_matrix([*texts, "", "pump " * 40, "pump " * 30 + "seal"]), 12), axis=0)
    c = density._counts(v)
    assert c is not None and c.dtype == np.uint8 and density._counts(v[1:] + 0.01) is None
    assert (density._unpacked(density._packed(c), *c.shape) == c).all() and np.allclose(density._unpacked(density._packed(v), *v.shape), v, atol=0)
    pairs = lambda i, j: set(zip(i.tolist(), j.tolist(), strict=True))
    core = np.sort(np.sqrt(np.maximum((v * v).sum(axis=1)[:, None] + (v * v).sum(axis=1) - 2 * v @ v.T, 0)), axis=1)
    radius, part = core[:, 6], rng.integers(0, 3, len(v))
    order = np.argsort(part, kind="stable")
    limits = np.where(np.eye(3) > 0, -1.0, 0.95)
    for a, b, same in ((slice(0, 350), slice(350, None), False), (slice(None), slice(None), True)):
        near = [density._neighbours(block(x[a]), block(x[b]), same, *((radius[s] ** 2).astype(np.float32) for s in (a, b))) for block, x in ((density._Block, v), (density._Counted, c))]
        assert len(near[0][0]) > 500 and pairs(*near[0][:2]) == pairs(*near[1][:2]) and np.allclose(np.sort(near[0][2]), np.sort(near[1][2]))
        i, j = order[a], order[b]
        own = [density._between(block(x[i]), block(x[j]), same, (part[i], part[j]), (core[i, 2], core[j, 2]), limits) for block, x in ((density._Block, v), (density._Counted, c))]
        assert len(own[0][2]) and np.allclose(np.sort(own[0][2]), np.sort(own[1][2]))
        # what lies within a radius is known
        assert not len(density._between(density._Counted(c[i]), density._Counted(c[j]), same, (part[i], part[j]), (core[i, 2], core[j, 2]), limits, (np.full(len(i), 0.95), np.full(len(j), 0.95)))[2])
    few = np.arange(8)
    every = np.full(8, np.inf, np.float32)
    assert len(density._neighbours(density._Counted(c[few]), density._Counted(c[few]), True, every, every)[0]) == 28
