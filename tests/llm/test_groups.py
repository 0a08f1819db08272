"""Near duplicates, clusters, packing and mixing against brute force on small fixtures."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import clusters, graph, mixing, near_dups, packing, tokens


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        i = rng.randrange(len(w))
        op = rng.choice("sdit")
        if op == "d" and len(w) > 4:
            del w[i]
        elif op == "i":
            w.insert(i, rng.choice(["again", "apparently", "now"]))
        elif op == "s" and i + 1 < len(w):
            w[i], w[i + 1] = w[i + 1], w[i]
        elif len(w[i]) > 3:
            k = rng.randrange(len(w[i]) - 1)
            w[i] = w[i][:k] + w[i][k + 1] + w[i][k] + w[i][k + 2 :]
    return " ".join(w)


def fixture(n=250, seed=9):
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice(["ka", "lor", "ven", "ti", "mo", "ras", "el", "qu", "zo", "ben"]) for _ in range(3)).capitalize()
    rows = []
    for i in range(n):
        t = rng.choice(["The {} audit of {} shows pump {} at {} passing {} units without a signature from {}.", "A witness named {} said the alarm {} on {} stayed silent at {} while {} litres were drawn by {}."])
        t = t.format(name(), name(), f"XY-{rng.randint(100, 9999)}", name(), rng.randint(1000, 99999), name())
        rows.append(t)
        for _ in range(rng.choice([0, 0, 1, 2])):
            rows.append(edited(rng, t, rng.randint(1, 4)))
        if rng.random() < 0.2:
            rows.append("  " + t.upper().replace(" ", "\t"))
    return rows


def brute(texts):
    s = [near_dups.letters(t) for t in texts]
    return {(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if s[i] == s[j] or near_dups.similarity(s[i], s[j]) >= near_dups.SIMILARITY}


def pairs_of(spark, rows, numeric=False):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "tbl string, id string, text string, hi string")
    return {(r.id_a, r.id_b) for r in near_dups._pairs(near_dups.reduced(df), numeric).dropDuplicates().collect()}


def test_near_duplicates_against_all_pairs(spark):
    texts = fixture()
    ids = [f"{i:04}" for i in range(len(texts))]
    want = {(ids[i], ids[j]) for i, j in brute(texts)}
    got = pairs_of(spark, list(zip(["t"] * len(texts), ids, texts, strict=True)))
    assert got <= want and len(got & want) >= 0.99 * len(want) > 50


def test_near_duplicates_take_odd_input(spark):
    long = "abcde " * 40_000
    rows = [("t", "1", "abcd"), ("t", "2", "ABCD!"), ("t", "3", "abce"), ("t", "4", ""), ("t", "5", "..."), ("t", "6", None), ("t", None, "abcd"), ("t", "7", long), ("t", "8", long + "x"), ("t", "7", long), ("t", "9", "x: 1; y: 2; zeta: 3"), ("t", "10", "zeta: 3; y: 2; x: 1")]
    assert pairs_of(spark, rows) == {("1", "2"), ("4", "5"), ("7", "8"), ("10", "9")}
    assert pairs_of(spark, rows, numeric=True) == {("1", "2"), ("4", "5"), ("7", "8"), ("9", "10")}
    empty = spark.createDataFrame([], "tbl string, id string, text string")
    assert near_dups._pairs(near_dups.reduced(empty), False).count() == 0


def test_a_third_of_all_rows_is_one_node(spark):
    rows = spark.range(3_000).select(F.lit("t").alias("tbl"), F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "the same sentence over and over").otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    forms = near_dups.reduced(rows)
    assert near_dups.links(forms).count() == 0
    assert forms.where("s is not null").count() <= 2_000 + forms.rdd.getNumPartitions() * 8


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randint(0, 30), 100 + rng.randint(0, 30)) for _ in range(40)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------------------------------ p5
def reports():
    rng = random.Random(3)
    rows, truth = [], {}
    for k in range(40):
        code, site, wrong = f"{rng.choice('ABCXYZ')}{rng.choice('KLMN')}-{1000 + 7 * k}", f"Site{''.join(rng.choice('abcdefghijklm') for _ in range(8))}", k % 5 == 0
        for i in range(rng.randint(1, 6)):
            person = "".join(rng.choice("opqrstuvw") for _ in range(7)).capitalize()
            place = site[:5] + site[6] + site[5] + site[7:] if wrong and i == 0 else site[:-1] if wrong and i == 1 else site
            t = rng.choice(["Staff in {s} reset pump {c} without notice; {p} wrote it down.", "{p} found that valve {c} had been opened at {s}.", "In {s} fehlt laut {p} die Pumpe {c}.", "{s}の記録には{c}と書かれ、{p}が署名した。"]).format(s=place, c=code.replace("-", rng.choice(["-", "–", " ", "/"])), p=person)
            t = rng.choice([str, str.upper, str.lower])(t) if " " not in code.replace("-", "") and "の" not in t and "fehlt" not in t and "–" in t else t
            rows.append((f"{k:02}{i:02}", t))
            truth[f"{k:02}{i:02}"] = k
    return rows, truth


def groups(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "dp_id string, text string, code string")
    got = clusters.clustered(df)
    out = defaultdict(set)
    for r in got.collect():
        out[r.cluster].add(r.dp_id)
    return {frozenset(v) for v in out.values() if len(v) >= 3}


def test_clusters_of_reports(spark):
    rows, truth = reports()
    by = defaultdict(set)
    for i, k in truth.items():
        by[k].add(i)
    want = {frozenset(v) for v in by.values() if len(v) >= 3}
    assert groups(spark, rows) == want


def test_same_code_at_other_sites_stays_apart(spark):
    a = [(f"a{i}", f"Pump QX-1234 was seen at Norwickham by {n}.") for i, n in enumerate(["Adaro", "Belun", "Cesov"])]
    b = [(f"b{i}", f"Pump QX-1234 was seen at Elmstaford by {n}.") for i, n in enumerate(["Dorim", "Efrul", "Garan"])]
    odd = [(None, "Pump QX-1234 at Norwickham"), ("n1", None), ("n2", ""), ("n3", "no code at Norwickham"), ("n4", "12 QX 55"), ("a0", a[0][1]), ("n5", "QX-1234")]
    assert groups(spark, a + b + odd) == {frozenset(i for i, _ in a), frozenset(i for i, _ in b)}
    assert groups(spark, []) == set()


def vector_nodes(spark, m, sizes):
    """Nodes of the rows of a matrix of features."""
    rows = [(f"{i:04}", int(z), [int(x) for x in np.flatnonzero(v)], [float(x) for x in v[v > 0]], [0.0] * int((v > 0).sum())) for i, (v, z) in enumerate(zip(m, sizes, strict=True))]
    return clusters.pooled(spark.createDataFrame(rows, "node string, size long, f array<long>, w array<double>, o array<double>"))


def average_linkage(m, sizes, tags, threshold):
    """All rounds over the whole matrix of average similarities, which are kept as sums over pairs of members."""
    sums = (m @ m.T) * np.outer(sizes, sizes)
    size, member, live = list(sizes), {i: {i} for i in range(len(m))}, list(range(len(m)))
    while True:
        s = np.array([[sums[i, j] / (size[i] * size[j]) for j in live] for i in live])
        best = {i: j for i, j, _, _ in clusters._choices(s, [tags[i] for i in live], threshold)}
        pairs = [(live[i], live[j]) for i, j in best.items() if i < j and best.get(j) == i]
        if not pairs:
            return {frozenset(v) for v in member.values()}
        for a, b in pairs:
            sums[a] += sums[b]
            sums[:, a] += sums[:, b]
            size[a] += size[b]
            member[a] |= member.pop(b)
            live.remove(b)


@pytest.mark.parametrize("features", [1, 3])
def test_linkage_is_average_linkage(spark, features):
    rng = np.random.default_rng(4)
    m = rng.random((40, 12)) * (rng.random((40, 12)) < 0.25) + np.eye(12)[rng.integers(0, 12, 40)] * features
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    sizes = rng.integers(1, 4, 40)
    nodes = vector_nodes(spark, m, sizes)
    tags = [r.t for r in nodes.select("node", F.xxhash64("node").alias("t")).orderBy("node").collect()]
    want = average_linkage(m, sizes, tags, 0.8)
    report = []
    got = defaultdict(set)
    placed = {r.node: r.cluster for r in clusters.linkage(nodes, report=report).collect()}
    for i in range(40):
        got[placed.get(f"{i:04}", f"{i:04}")].add(i)
    assert {frozenset(v) for v in got.values()} == want
    assert any(len(v) > 2 for v in want) and sum(r["merges"] + r["in_place"] for r in report) == 40 - len(want)


def test_lists_larger_than_a_block_lose_no_pair(spark):
    n = 3 * clusters.BLOCK
    m = np.zeros((n, n + 1))
    m[:, 0] = 0.55  # all share a feature that is in every prefix, yet only rows of one kind are similar
    for i in range(n):
        m[i, 1 + (i % 3 if i < 40 else i)] = (1 - 0.55**2) ** 0.5
    placed = {r.node: r.cluster for r in clusters.linkage(vector_nodes(spark, m, [1] * n)).collect()}
    got = defaultdict(set)
    for i in range(n):
        got[placed.get(f"{i:04}", f"{i:04}")].add(i)
    assert sorted(v for v in got.values() if len(v) > 1)[:3] == [{i for i in range(40) if i % 3 == k} for k in range(3)]
    assert len(got) == 3 + n - 40


def test_records_without_a_code_cluster_by_their_words(spark):
    rows = [(f"a{i}", t) for i, t in enumerate(["The old bridge near Norwick fell into the river at dawn", "the old bridge near Norwick fell into the river at dawn!", "At dawn the old bridge near Norwick fell into the river again"])]
    rows += [("b1", "Nobody saw the harbour master leave"), ("b2", "Rain is expected over the southern hills"), ("b3", "")]
    assert groups(spark, rows) == {frozenset(["a0", "a1", "a2"])}


def test_an_item_that_a_third_of_all_rows_report_is_one_cluster(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(4)).capitalize()
    hot = [(f"h{i}", f"Pump QX-1234 at Norwickham lost pressure, as {word()} {word()} wrote.") for i in range(300)]
    rest = [(f"r{i}", f"Valve {rng.choice('ABCD')}K-{1000 + i} at {word()} lost pressure, as {word()} {word()} wrote.") for i in range(600)]
    assert groups(spark, hot + rest) == {frozenset(i for i, _ in hot)}


# ------------------------------------------------------------------------------------------ p8, p9
def test_more_shards_than_blocks_of_old_get_their_fair_share(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.lit("one two three").alias("text"))
    rows = mixing.mix(docs, {"a": (0.5, 2), "b": (0.5, 1)}, shards=700).groupBy("shard").agg(F.countDistinct("source").alias("n")).collect()
    assert len(rows) == 700 and sum(r.n == 2 for r in rows) > 600


def test_packing_is_whole_tight_and_bounded(spark):
    rng = random.Random(5)
    sizes = [(i, min(1500, int(rng.lognormvariate(4.5, 1)))) for i in range(1200)] + [(5000, 0), (5001, 700)]
    caps = {"a": 300, "b": 512}
    got = packing.packings(spark.createDataFrame(sizes, "doc_id long, tokens long"), caps).collect()
    for c, cap in caps.items():
        fill, parts = Counter(), Counter()
        for r in got:
            if r.container == c:
                fill[r["round"], r.part, r.bin] += r.tokens
                parts[r.doc_id] += r.tokens
                assert r.tokens <= cap
        assert parts == Counter(dict(sizes)) or all(parts[d] == t for d, t in sizes)
        assert max(fill.values()) <= cap and all(len([r for r in got if r.container == c and r.doc_id == d]) == max(1, -(-t // cap)) for d, t in sizes[:50])
        values, counts = np.unique([r.tokens for r in got if r.container == c], return_counts=True)
        assert packing.lower_bound(values, counts, cap) <= len(fill) <= 1.02 * packing.lower_bound(values, counts, cap) + 1
    assert packing.packings(spark.createDataFrame([], "doc_id long, tokens long"), caps).count() == 0
    assert packing.packings(spark.createDataFrame(sizes[:3], "doc_id long, tokens long"), {}).count() == 0


def test_exchange_between_partitions_saves_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_ITEMS", 40)
    rng = random.Random(6)
    sizes = spark.createDataFrame([(i, rng.randint(60, 180)) for i in range(900)], "doc_id long, tokens long")
    got = packing.packings(sizes, {"a": 256})
    bins = got.select("round", "part", "bin").distinct().count()
    alone = packing._bins(packing._pack(sizes.select(F.lit("a").alias("container"), "doc_id", F.lit(0).alias("part_no"), "tokens"), {"a": 256}, 0))
    assert got.count() == 900 and bins < alone


@pytest.mark.parametrize(("sizes", "cap", "least"), [([6, 6, 6], 10, 3), ([5, 5, 5, 5], 10, 2), ([4, 4, 4], 10, 2), ([7, 4, 4, 3], 10, 2), ([51] * 7, 100, 7), ([], 10, 0)])
def test_lower_bounds(sizes, cap, least):
    v, n = np.unique(np.array(sizes, dtype=np.int64), return_counts=True)
    assert packing.lower_bound(v, n, cap) == least


def test_split_tree_is_exact():
    draws = np.array([1000, 37, 0, 5])
    dealt = mixing.split_tree(draws, 7, np.random.default_rng(0))
    assert dealt.shape == (7, 4) and (dealt.sum(axis=0) == draws).all() and dealt.sum(axis=1).max() - dealt.sum(axis=1).min() <= 3
    assert (dealt >= 0).all()


def test_plan_keeps_shares_repeats_and_blocks():
    rng = np.random.default_rng(1)
    blocks = pd.DataFrame([(s, b, int(rng.integers(50, 150))) for s, n in (("big", 300), ("small", 20), ("tiny", 3)) for b in range(n)], columns=["source", "block", "tokens"])
    targets = {"big": (0.5, 1), "small": (0.3, 4), "tiny": (0.1, 8), "none": (0.1, 2)}
    out = mixing.plan(blocks, targets, shards=4)
    size = {(r.source, r.block): r.tokens for r in blocks.itertuples()}
    got = Counter()
    for r in out.itertuples():
        got[r.source] += r.budget if r.budget == r.budget and r.budget is not None else size[r.source, r.block]
    total = sum(got.values())
    assert all(math.isclose(got[s] / total, targets[s][0] / 0.9, rel_tol=1e-6) for s in ("big", "small", "tiny"))
    assert not out.duplicated(["source", "block", "repeat_no"]).any() and all((out[out["source"] == s]["repeat_no"] < targets[s][1]).all() for s in targets)
    assert len(mixing.plan(blocks.iloc[:0], targets)) == 0


def test_mix_rows(spark):
    if not __import__("os").path.isdir(tokens.TOKENIZER_DIR):
        pytest.skip("no vocabularies")
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(3, 40))), "Big " if i % 10 else "small-one", "c") for i in range(600)] + [(900, None, "big", "c"), (None, "x", "big", "c"), (1, "alpha", "big", "c"), (901, "", "big", "c"), (902, "y", None, "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens string")
    targets = mixing.targets_of(spark.createDataFrame([("big", 0.75, 1), ("small one", 0.25, 3), (None, 0.1, 1), ("x", None, 1), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int"))
    rows = mixing.mix(df, targets, shards=4).collect()
    by, uses = Counter(), Counter()
    for r in rows:
        by[r.source] += r.tokens
        uses[r.doc_id, r.source] += 1
    assert abs(by["big"] / sum(by.values()) - 0.75) < 0.02 and max(n for (_, s), n in uses.items() if s == "big") == 1 and max(uses.values()) <= 3
    assert all(sorted(r.position for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows))) for k in range(4))
    assert mixing.mix(df.limit(0), targets).count() == 0


def test_tiny_source_does_not_bound_the_mix(spark, tmp_path):
    if not __import__("os").path.isdir(tokens.TOKENIZER_DIR):
        pytest.skip("no vocabularies")
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(20)), "tiny" if i < 2 else "a" if i % 2 else "b") for i in range(800)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", 0.55, 2), ("b", 0.4, 2), ("tiny", 0.05, 3)], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    got = {r.source: r for r in mixing.p9_shares(spark, str(tmp_path)).collect()}
    assert got["tiny"].tokens and got["tiny"].n_docs == 2 and got["tiny"].most_uses == 3 and got["tiny"].share < 0.05
    assert abs(got["a"].tokens / got["b"].tokens - 0.55 / 0.4) < 0.05 and got["a"].n_docs == got["b"].n_docs + 0 == 399
    assert max(r.most_uses for r in got.values()) <= 3 and got["a"].most_uses == got["b"].most_uses == 2


def test_mix_size_gives_up_shares_only_for_a_mix_below_the_text():
    targets = {"big": (0.5, 1), "mid": (0.42, 2), "tiny": (0.08, 2)}
    assert mixing.mix_size({"big": 500, "mid": 400, "tiny": 60}, targets, 0.9) == 1000
    assert mixing.mix_size({"big": 500, "mid": 400, "tiny": 4}, targets, 0.9) == 1000
    assert math.isclose(mixing.mix_size({"big": 500, "mid": 400, "tiny": 4}, targets, 0.95), 100) and math.isclose(mixing.mix_size({"big": 500, "mid": 400, "tiny": 4}, targets), 100)
    assert mixing.mix_size({}, targets, 0.9) == 0.0


def test_token_counts_round_trip():
    if not __import__("os").path.isdir(tokens.TOKENIZER_DIR):
        pytest.skip("no vocabularies")
    enc = tokens.encoding(tokens.TOKENIZER_DIR)
    for t in ("Hello, wörld!", "屏幕过了5分钟", " \n\t x", "<|endoftext|>"):
        assert enc.decode(enc.encode_ordinary(t)) == t and tokens.token_count(t) == len(enc.encode_ordinary(t)) > 0
    assert tokens.token_count(None) == tokens.token_count("") == 0


def test_an_edited_text_of_common_runs_meets_the_others(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "RARE_TEXTS", 0)
    base = "the crew left the north hall at four in the afternoon and nothing else was written down in the book of the day by any of them"
    texts = [base.replace("four", f"four {'again ' * k}") for k in range(3)] + [base.replace("hall", "hlal")] * 1
    rows = [("t", str(i), t) for i, t in enumerate(texts)] + [("t", f"x{i}", f"{base} number {i} of the list") for i in range(30)]
    want = {(str(i), str(j)) for i in range(4) for j in range(i + 1, 4) if near_dups.similarity(near_dups.letters(texts[i]), near_dups.letters(texts[j])) >= near_dups.SIMILARITY}
    got = {(a, b) for a, b in pairs_of(spark, rows) if not a.startswith("x") and not b.startswith("x")}
    assert got == want


def test_near_duplicates_in_rounds_are_those_of_one(spark, monkeypatch):
    texts = fixture()
    rows = list(zip(["t"] * len(texts), [f"{i:04}" for i in range(len(texts))], texts, strict=True))
    want = pairs_of(spark, rows)
    monkeypatch.setattr(near_dups, "ROUND_TEXTS", len({near_dups.letters(t) for t in texts}) // 2)
    monkeypatch.setattr(near_dups, "PAIRS_A_TEXT", 1)
    assert len(near_dups._rounds(len(texts))) > 1 and sorted(sum(near_dups._rounds(10**9), [])) == list(range(near_dups.BANDS))
    assert pairs_of(spark, rows) == want
