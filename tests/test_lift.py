"""Scale, text and oracle functions on literal rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import scale, text
from tessera.operators import scoring
from tessera.plans import settings as S


def values(df):
    return [tuple(r) for r in df.collect()]


def test_lift_scale_is_monotone_and_bounded(spark):
    order = ["ruled_out", "much_less", "less", "unchanged", "more", "much_more"]
    rows = [(c, p) for p in (1e-4, 0.5, 0.999) for c in [*order, "guaranteed"]]
    got = spark.createDataFrame(rows, "c string, p double").select("c", "p", scale.lift_of_change("c", "p").alias("x")).collect()
    assert all(1e-3 <= r.x <= 20 for r in got)
    for p in (1e-4, 0.5, 0.999):
        by = {r.c: r.x for r in got if r.p == p}
        assert [by[c] for c in order] == sorted(by[c] for c in order)
    assert {r.x for r in got if r.c == "guaranteed" and r.p == 0.5} == {0.97 / 0.5}


@pytest.mark.parametrize(
    ("x", "want"),
    [(-2.0, "strongly_contradicts"), (-1.0, "contradicts"), (-0.5, "contradicts"), (-0.3, "neutral"), (0.0, "neutral"), (0.3, "supports"), (0.5, "supports"), (1.0, "strongly_supports"), (2.0, "strongly_supports"), (float("nan"), "neutral"), (float("inf"), "neutral"), (None, "neutral")],
)
def test_verdict_bands(spark, x, want):
    assert values(spark.createDataFrame([(x,)], "x double").select(scale.verdict("x"))) == [(want,)]


def test_change_label_and_safe_numbers(spark):
    rows = spark.createDataFrame([(" MORE ",), ("nonsense",), (None,), ("Guaranteed",)], "c string")
    assert [r[0] for r in values(rows.select(scale.change_label("c")))] == ["more", "unchanged", "unchanged", "guaranteed"]
    nums = spark.createDataFrame([("0.7",), ("very likely",), ("nan",), ("inf",), (None,), ("1e3",), ("0.7d",)], "x string")
    assert [r[0] for r in values(nums.select(scale.safe_double("x", 0.5)))] == [0.7, 0.5, 0.5, 0.5, 0.5, 1000.0, 0.5]


def test_content_id_and_set_key(spark):
    df = spark.createDataFrame([("Grüße ",), ("",)], "t string")
    want = [hashlib.sha256(t.encode() + b"\0").hexdigest()[:16] for t in ("Grüße ", "")]
    assert [r[0] for r in values(df.select(text.content_id("t")))] == want
    keys = spark.createDataFrame([(["b", "a"],), (["a", "b", "a"],)], "x array<string>").select(text.set_key("x"))
    assert {r[0] for r in values(keys)} == {"a,b"}


def test_sentences_and_atoms(spark):
    t = "First one. Second 2 here!  Third? no 4 lower. 5 is last"
    df = spark.createDataFrame([(t,), ("   ",), (None,)], "t string")
    got = [r[0] for r in values(df.select(text.simple_sentences("t")))]
    assert got == [["First one.", "Second 2 here!", "Third? no 4 lower.", "5 is last"], [], None]
    atoms = spark.createDataFrame([("Short. This one is long enough. This one is long enough.",), ("tiny",)], "t string")
    assert [r[0] for r in values(atoms.select(text.kept_atoms(text.oracle_atoms("t"))))] == [["This one is long enough."], []]


def test_tokens_entities_and_cues(spark):
    t = "The Mixer-Room failed on 2024-03-01, not before; 12,5% lost in Berlin"
    r = spark.createDataFrame([(t, '{"source": "Desk", "shift": ""}')], "t string, m string").select(text.oracle_tokens("t"), text.screen_tokens("t"), text.entities("t", "m"), text.negative("t")).first()
    words = {w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) > 2 and w not in S.ORACLE_STOP}
    assert set(r[0]) == words
    assert "mixer-room" in r[1] and "not" not in r[1]
    assert {"mixer-room", "2024-03-01", "12,5", "berlin", "desk"} <= set(r[2]) and "" not in r[2]
    assert r[3] is True


def test_oracle_json_shapes(spark):
    rows = ['{"a": 1}', '```json\n{"a": 2}\n```', 'so {"a": 3} it is', "none", "", None, "{broken"]
    df = spark.createDataFrame([(x,) for x in rows], "x string").select(F.get_json_object(text.oracle_json("x"), "$.a"))
    assert [r[0] for r in values(df)] == ["1", "2", "3", None, None, None, None]


HYPS = [("h1", "The mixer ran without any flour after the shift"), ("h2", "Invoices were altered by the night clerk")]
POINTS = [("p1", "The mixer ran with flour during the whole shift"), ("p2", "No invoices were altered"), ("p3", "A choir sang"), ("p4", "")]


def test_sparse_grid_equals_the_full_one(spark):
    h, p = spark.createDataFrame(HYPS, "hyp_id string, text string"), spark.createDataFrame(POINTS, "dp_id string, text string")
    full = scoring.grid(h, p, scoring.LexicalOracle())
    assert full.count() == len(HYPS) * len(POINTS)
    assert all(abs(r.log_lift) < 20 and r.verdict for r in full.collect())
    dense = {(r.hyp_id, r.dp_id, r.change) for r in full.where("change <> 'unchanged'").collect()}
    sparse = {(r.hyp_id, r.dp_id, r.change) for r in scoring.lexical_cells(h, p).collect()}
    assert dense == sparse and dense


def test_grid_judges_only_misses(spark):
    h, p = spark.createDataFrame(HYPS, "hyp_id string, text string"), spark.createDataFrame(POINTS, "dp_id string, text string")

    class Counting(scoring.LexicalOracle):
        asked = 0

        def cells(self, pairs):
            Counting.asked = pairs.count()
            return super().cells(pairs)

    oracle = Counting()
    first = scoring.grid(h, p, oracle).cache()
    assert Counting.asked == 0 or Counting.asked == 8
    again = scoring.grid(h, p, oracle, first)
    assert again.count() == 8 and Counting.asked == 0


def test_remote_oracle_faults(spark):
    pairs = spark.createDataFrame([("h", "H", f"d{i}", t) for i, t in enumerate(["ok", "bad", "empty", "off"])], "hyp_id string, hyp string, dp_id string, dp string").coalesce(1)

    def connect():
        def call(prompt, tokens, json_mode):
            if "bad" in prompt:
                raise OSError("down")
            if "empty" in prompt:
                return ""
            if "off" in prompt:
                return '{"change": "sideways", "prior": 7.3, "relatedness": "kind of"}'
            return '```json\n{"change": "MORE\\t", "prior": "0.25", "relatedness": 1.5, "why": "x", "hypothesis": " One cause. ", "data_points": ["The valve was shut.", "no", "The valve was shut.", null]}\n```'

        return call

    calm = lambda s: None
    oracle = scoring.RemoteOracle("m", connect, pause=calm)
    got = {r.dp_id: r for r in oracle.cells(pairs).collect()}
    assert (got["d0"].change, got["d0"].prior, got["d0"].relatedness, got["d0"].status) == ("more", 0.25, 1.0, "ok")
    assert (got["d3"].change, got["d3"].prior, got["d3"].relatedness) == ("unchanged", 0.99, 0.0)
    assert got["d1"].status != "ok" and got["d2"].status != "ok" and got["d1"].change == "unchanged"
    told = scoring.failures(oracle.cells(pairs)).first()
    assert told.ok == 2 and told.failed == 2 and told.degraded and len(told.errors) == 2 and any("down" in e for e in told.errors)
    sets = spark.createDataFrame([("h", "claim", "a,b", ["one", "two"], 0.2), ("h", "bad", "c", ["x"], 0.5)], "hyp_id string, hyp string, set_key string, members array<string>, prior double")
    joint = {r.set_key: r for r in oracle.joint(sets).collect()}
    assert (joint["a,b"].change, joint["a,b"].lift, joint["a,b"].status) == ("more", 2.0, "ok") and joint["c"].lift == 1.0 and joint["c"].status != "ok"
    chunks = spark.createDataFrame([("1", "1::c0", 0, "passage"), ("1", "1::c1", 1, "bad")], "doc_id string, chunk_id string, ord int, text string")
    assert [(r.chunk_id, r.pos, r.text) for r in oracle.atoms(chunks).collect()] == [("1::c0", 0, "The valve was shut.")]
    clusters = spark.createDataFrame([(0, ["a", "b"])], "cluster int, members array<string>")
    assert oracle.proposals(clusters).first().hypothesis == "One cause."
    dead = scoring.RemoteOracle("m", lambda: (lambda *_: (_ for _ in ()).throw(OSError("down"))), pause=calm)
    with pytest.raises(Exception, match="none succeeded"):
        dead.cells(pairs).collect()


def test_prompts_by_their_phrases(spark):
    prompts = ["Split the passage", "atomic propositions", "Propose ONE single hypothesis", "taken TOGETHER as a single combined fact", "a Base Rate", "Topically related", "what would change in this scenario", "hello"]
    got = values(spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "i int, p string").orderBy("i").select(text.prompt_kind("p")))
    assert [g[0] for g in got] == ["atomize", "atomize", "abduce", "joint_lift", "prior", "relatedness", "lift", "unknown"]
    fields = spark.createDataFrame([("A: one (x)\nB: two",), ("no",)], "p string").select(text.labelled_field("p", "A:"), text.labelled_field("p", "B:"))
    assert values(fields) == [("one (x)", "two"), ("", "")]


def test_tries_of_a_remote_call():
    seen, waits = [], []

    def call(prompt, tokens, json_mode):
        seen.append((tokens, json_mode))
        if len(seen) == 3:
            raise OSError("busy")
        return "" if len(seen) < 4 else '{"change": "less"}'

    assert scoring.asked(call, "p", 500, 5, waits.append) == ('{"change": "less"}', "ok")
    assert seen == [(500, True), (1200, False), (2400, False), (2400, False)] and waits == [0.5, 1.0, 3.0]
    seen.clear()
    waits.clear()
    assert scoring.asked(lambda *_: None, "p", 500, 2, waits.append) == (None, "failed: no object") and waits == [0.5]


def test_grid_asks_for_a_prior_once_a_data_point(spark):
    hyps = spark.createDataFrame([("h1", "the pump seal cracked"), ("h2", "a choir sang")], "hyp_id string, text string")
    points = spark.createDataFrame([("d1", "only the pump seal cracked at night"), ("d2", "nothing")], "dp_id string, text string")
    got = {(r.hyp_id, r.dp_id): r for r in scoring.grid(hyps, points, scoring.LexicalOracle()).collect()}
    assert len(got) == 4 and got["h1", "d1"].change == "much_more" and got["h2", "d1"].change == "unchanged"


def test_sparse_grid_answers_like_the_whole_grid(spark):
    from tessera.functions import scale
    from tessera.operators import matrix

    hyps = spark.createDataFrame([(f"h{i}", t) for i, t in enumerate(["the pump seal cracked at night", "the choir sang in the hall", "no pump ran at night", ""])], "hyp_id string, text string")
    points = spark.createDataFrame([(f"d{i}", t, 0.5 + i / 4) for i, t in enumerate(["pump seal cracked", "no seal cracked at night", "the choir sang", "unrelated words here", ""])], "dp_id string, text string, cred double")
    whole = scoring.grid(hyps, points, scoring.LexicalOracle()).join(points.select("dp_id", "cred"), "dp_id")
    want = {r.hyp_id: (round(r.score, 9), r.n, r.n_supporting, r.n_contradicting, r.n_neutral, r.verdict) for r in matrix.hypothesis_scores(whole).collect()}
    got = {r.hyp_id: (round(r.score, 9), r.n, r.n_supporting, r.n_contradicting, r.n_neutral, r.verdict) for r in scoring.lexical_scores(hyps, points).collect()}
    assert got == want and len(want) == 4
    spread = {r.dp_id: round(r.diagnosticity, 9) for r in matrix.diagnosticity(whole).collect()}
    assert {r.dp_id: round(r.diagnosticity, 9) for r in scoring.lexical_diagnosticity(hyps, points).collect()} == spread
    assert scoring.lexical_scores(hyps, points.limit(0)).where("n = 0 and score = 0 and verdict = 'neutral'").count() == 4
    assert hyps.select(scale.change_label(F.lit("\tmore\u00a0\n")).alias("c")).first().c == "more"


def test_entities_match_a_plain_version(spark):
    rows = ["The Mixer-Room at Halle lost 12,5% on 2024-03-01.", "nothing here", "ABC de Fgh 7 1.000 x9", ""]
    df = spark.createDataFrame([(t, '{"source": "Desk A", "oven": "3"}') for t in rows], "t string, m string").select("t", text.entities("t", "m").alias("e"))
    for r in df.collect():
        want = set(re.findall(r"\b[A-Z][a-zA-Z\-]{2,}\b", r.t)) | set(re.findall(r"\b\d{4}-\d{2}-\d{2}\b|\b\d+(?:[.,]\d+)?%?\b", r.t)) | {"Desk A", "3"}
        assert set(r.e) == {w.lower() for w in want}


def test_embedders(spark):
    import numpy as np

    from tessera.functions import vectors

    texts = ["the pump seal cracked", "the pump seal", "", "choir night"]
    dense = vectors.hash_matrix(texts)
    sparse = vectors.sparse_hashing(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), ["i"], "t").collect()
    got = np.zeros_like(dense)
    for r in sparse:
        got[r.i, r.bucket] = r.weight
    assert np.allclose(got, dense) and np.allclose(np.linalg.norm(dense, axis=1), [1, 1, 0, 1])
    tfidf = vectors.tfidf_matrix(texts[:2], stop=("the",))
    assert np.allclose(np.linalg.norm(tfidf, axis=1), 1) and 0 < tfidf[0] @ tfidf[1] < 1 and vectors.tfidf_matrix(["x"]).tolist() == [[1.0]]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    out = vectors.model_embeddings(rows, "t", "v", lambda: lambda ts: np.array([[len(t), 1.0] for t in ts])).collect()
    assert len(out) == 4 and all(abs(sum(x * x for x in r.v) - 1) < 1e-9 for r in out)
    unit = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(vectors.unit("v")).collect()
    assert [r[0] for r in unit] == [[0.6, 0.8], [0.0, 0.0]]
