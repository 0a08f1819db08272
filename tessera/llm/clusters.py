"""Clusters of records that report on the same item at the same site: reciprocal-nearest-neighbour average linkage.

Each distinct report (the same identifier and names, however laid out) is a node with a sparse vector, and the similarity of two
nodes is the product of their vectors. Half of a vector's square is the identifier of the item (letters joined to digits); the
other half are the names, weighted by the share of the identifier's reports that have them, so that the site, which reports agree
on, outweighs the persons, which change. Names count with their letters sorted, as swapped letters make no difference, and a name
one letter off a better supported one of its identifier counts as that. A record without an identifier is the vector of its
words, weighted by rarity, and so joins records of much the same words.

The graph is sparse: two nodes can only be as similar as asked when they share a feature of both prefixes (features in one
global order, up to where the rest is shorter than the threshold), so candidates come from lists of prefix features. As
similarity is a product, the mean vector of a cluster gives the average over all pairs of members exactly, without their edges.
Every round all pairs of clusters that are each other's best merge in parallel; similarities within ``STEP`` count as ties, which
fall to a hash of the pair. Averages never rise above the larger of the merged, so what has no partner leaves the graph, and a
list whose nodes are in no other is linked to its end where it is. A list of more than ``BLOCK`` nodes is dealt into blocks anew every
round, and once nothing merges all pairs of its blocks are compared, so no pair is lost and no task holds a whole list.

Defined results for odd input: null ids and null or empty texts are in no cluster, nor are records of an identifier without any
name; repeated rows of an id count once; very long texts are read whole and their first identifier is the item's; empty tables give no
clusters; further columns are not read. In a mean vector entries under ``LEAST_MEAN`` are left out: they change a similarity by less
than that times the sum of the other's entries.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.shared import cut, stored, table

#: Clusters are merged while their average similarity is at least this.
THRESHOLD = 0.8
LEAST_SIZE = 3
#: A word mostly written small is no name when more than so many records have it, plus a share of all records.
NAME_RECORDS, NAME_SHARE = 5, 0.002
#: Power of the support of a name among the reports of its identifier.
SUPPORT_POWER = 4
TYPICAL = 3
#: Nodes of a list that are compared in one block; similarities that differ by less than a step are ties.
BLOCK, STEP = 64, 0.05
LEAST_MEAN = 0.01

_INVISIBLE = regex.compile(r"\p{Cf}+")
_JOINED = regex.compile(r"(?<![a-z0-9])([a-z]{2})\s?[-‐‑‒–—−/_.]?\s?(?<!\s)(\d{3,4})(?![0-9])", regex.I)
_SPACED = regex.compile(r"(?<![A-Za-z0-9])([A-Za-z]{2})\s+(\d{3,4})(?![\d])")
_YEAR = regex.compile(r"(?:19|20)\d\d")
_NAME = regex.compile(r"[\p{Latin}\p{M}]{4,}")
_WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")


def item_code(text: str) -> str | None:
    """The code of the item in a normalised text: letters joined to a number; apart, only if it is no year or amount."""
    m = _JOINED.search(text)
    if m:
        return (m[1] + m[2]).upper()
    spaced = [m for m in _SPACED.finditer(text) if not _YEAR.fullmatch(m[2])]
    upper = [m for m in spaced if m[1].isupper()]
    m = (upper or spaced or [None])[0]
    if m is None:
        m = next(_SPACED.finditer(text), None)
    return (m[1] + m[2]).upper() if m else None


def names(text: str) -> tuple[list[str], list[int]]:
    """The Latin words of a normalised text, each by its sorted letters, once; and how each is written.

    1: with a capital though not first, -1: small, 0: no evidence, as in texts all in capitals or with a capital on every word.
    """
    found = _NAME.findall(text)
    small = sum(w.islower() for w in found)
    script = not text.isascii() and small == 0 and len(found) <= 4  # another script around Latin names
    plain = 3 * small >= len(found) and small < len(found) or script
    forms: dict[str, int] = {}
    for i, w in enumerate(found):
        form = "".join(sorted(w.casefold()))
        forms.setdefault(form, 0)
        if plain and w.islower():
            forms[form] = -1
        elif plain and (i or script) and w[0].isupper() and forms[form] == 0:
            forms[form] = 1
    return list(forms), list(forms.values())


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Codes and names of records (their words where there is no code); the task's word counts follow as one row without id."""
    seen: dict[str, list[int]] = {}
    for b in batches:
        codes, words = [], []
        for t in b["text"]:
            if not t.isascii():
                t = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", _INVISIBLE.sub("", t)))
            codes.append(code := item_code(t))
            found, case = names(t)
            if code is None:
                words.append(sorted({"".join(sorted(w)) for w in _WORD.findall(t.casefold())}))
            else:
                words.append(sorted(w for w, c in zip(found, case, strict=True) if c >= 0))
            for w, c in zip(found, case, strict=True):
                cell = seen.get(w)
                if cell is None:
                    seen[w] = [1, c]
                else:
                    cell[0] += 1
                    cell[1] += c
        yield pd.DataFrame({"dp_id": b["dp_id"], "code": codes, "names": words, "records": None, "capitals": None})
        if len(seen) > 200_000:
            yield _counts(seen)
            seen = {}
    if seen:
        yield _counts(seen)


def _counts(seen: dict[str, list[int]]) -> pd.DataFrame:
    return pd.DataFrame({"dp_id": [None], "code": [None], "names": [list(seen)], "records": [[n for n, _ in seen.values()]], "capitals": [[c for _, c in seen.values()]]})


def profiles(records: DataFrame) -> DataFrame:
    """(dp_id, code, names, node) of the records that may be in a cluster, repeated rows included; ``node`` names their report.

    Names are words that few records have, or mostly with a capital. Records of a code that fewer than ``LEAST_SIZE`` share are
    left out, as they are similar to no others.
    """
    rows = records.where("dp_id is not null and text is not null").select("dp_id", "text")
    read = stored(rows.mapInPandas(_extract, "dp_id string, code string, names array<string>, records array<long>, capitals array<long>"))
    counted = read.where("dp_id is null").select(F.explode(F.arrays_zip("names", "records", "capitals")).alias("w")).select("w.*")
    words = counted.groupBy("names").agg(F.sum("records").alias("n"), F.sum("capitals").alias("capitals"))
    coded = read.where("dp_id is not null").select("dp_id", "code", "names")
    # records have a few dozen words, so at most that many words over NAME_SHARE are common: a bounded list
    usual = F.col("n") > NAME_RECORDS + NAME_SHARE * coded.count()
    common = [r.names for r in words.where(usual & (F.col("capitals") <= 0)).toLocalIterator()]
    several = coded.where("code is not null").groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SIZE).select("code")
    of_code = coded.join(several, "code", "left_semi").select("dp_id", "code", F.filter("names", lambda w: ~w.isin(common)).alias("names"))
    without = coded.where("code is null").select("dp_id", "code", "names")
    kept = of_code.unionByName(without).where(F.size("names") > 0)
    return kept.withColumn("node", F.concat_ws(" ", "code", F.hex(F.xxhash64("names"))))


# ------------------------------------------------------------------------------------------------ vectors
def _near_forms(name: Column) -> Column:
    """A name and the name less each of its letters: two names that differ by one letter have one of these in common."""
    at = F.sequence(F.lit(1), F.length(name))
    return F.array_distinct(F.concat(F.array(name), F.transform(at, lambda i: F.concat(F.substring(name, 1, i - 1), F.substring(name, i + 1, F.length(name))))))


def _spelt(support: DataFrame) -> DataFrame:
    """(code, name, better): names that are one letter off a better supported one, for codes whose reports have no name in common."""
    unsettled = support.groupBy("code").agg(F.max(F.col("n") - F.col("m")).alias("short")).where("short < 0").select("code")
    forms = support.join(unsettled, "code", "left_semi").where(F.length("name") >= 5).select("code", "name", "n", F.explode(_near_forms(F.col("name"))).alias("form"))
    hub = forms.groupBy("code", "form").agg(F.max(F.struct("n", "name")).alias("hub"), F.count("*").alias("k")).where("k > 1").select("code", "form", "hub")
    led = forms.join(hub, ["code", "form"]).where("hub.name <> name").groupBy("code", "name").agg(F.max("hub").alias("hub"))
    return led.select("code", "name", F.col("hub.name").alias("better"))


def vectors(reports: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, size, f, w, o, prefix) of ``reports(node, code, names)``: the features of a node, their weights, their place in the global order.

    All vectors are at most 1 long. Those with an identifier have it first, and what follows is shorter than the threshold.
    """
    one = F.lit(1).cast("long").alias("size")
    of_code = reports.where("code is not null")
    totals = of_code.groupBy("code").agg(F.count("*").alias("m")).where("m > 1")
    said = stored(of_code.join(totals, "code").select("node", "code", "m", F.explode("names").alias("name")))
    support = stored(said.groupBy("code", "name").agg(F.count("*").alias("n"), F.max("m").alias("m")))
    spelt = support.join(_spelt(support), ["code", "name"], "left").withColumn("better", F.coalesce("better", "name"))
    backed = spelt.groupBy("code", "better").agg(F.sum("n").alias("backing"))
    # a name of one report only is nothing to share
    weight = F.pow(F.least(F.lit(1.0), F.col("backing") / F.col("m")), SUPPORT_POWER)
    shared = spelt.join(backed.where("backing > 1"), ["code", "better"]).select("code", "name", F.struct(F.xxhash64("code", "better").alias("f"), weight.alias("w")).alias("x"))
    named = said.join(shared, ["code", "name"]).groupBy("node").agg(F.collect_set("x").alias("x"), F.first(F.xxhash64("code")).alias("key"))
    norm = F.sqrt(F.lit(2.0) * F.aggregate("x", F.lit(0.0), lambda a, e: a + e["w"] * e["w"]))
    half = F.lit(0.5**0.5)
    coded = named.select("node", F.array_sort("x").alias("x"), norm.alias("norm"), "key").select(
        "node",
        one,
        F.concat(F.array("key"), F.transform("x", lambda e: e["f"])).alias("f"),
        F.concat(F.array(half), F.transform("x", lambda e: e["w"] / F.col("norm"))).alias("w"),
        F.concat(F.array(F.lit(0.0)), F.transform("x", lambda e: F.lit(1.0))).alias("o"),
        F.array("key").alias("prefix"),
    )
    free = reports.where("code is null")
    words = free.select("node", F.explode("names").alias("word"))
    held = words.groupBy("word").agg(F.count("*").alias("n"))
    rarity = F.log(1 + free.agg(F.count("*").alias("c")).first().c / F.col("n"))
    weighed = words.join(held, "word").groupBy("node").agg(F.collect_list(F.struct(F.xxhash64("word").alias("f"), rarity.alias("w"), F.col("n").cast("double").alias("o"))).alias("x"))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, e: a + e["w"] * e["w"]))
    worded = weighed.withColumn("norm", length).select("node", one, F.transform("x", lambda e: e["f"]).alias("f"), F.transform("x", lambda e: e["w"] / F.col("norm")).alias("w"), F.transform("x", lambda e: e["o"]).alias("o"))
    return coded.unionByName(pooled(worded, threshold))


# ------------------------------------------------------------------------------------------------ linkage
def _prefix(f: np.ndarray, w: np.ndarray, threshold: float) -> np.ndarray:
    """The features, in the global order, up to where those after are together shorter than the threshold."""
    rest = np.sqrt(np.maximum(np.cumsum((w * w)[::-1])[::-1], 0))
    return f[rest >= threshold - 1e-9]


def _pooled(threshold: float) -> object:
    """Mean vectors of the parts of each cluster, in the global order, with their prefixes."""

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for size, parts in zip(b["size"], b["parts"], strict=True):
                f, w, o = (np.concatenate([np.asarray(p[c]) for p in parts]) for c in ("f", "w", "o"))
                if len(parts) > 1:
                    w = w * np.repeat([p["size"] / size for p in parts], [len(p["f"]) for p in parts])
                    f, first, at = np.unique(f, return_index=True, return_inverse=True)
                    w, o = np.bincount(at, w), o[first]
                    keep = w >= LEAST_MEAN
                    f, w, o = f[keep], w[keep], o[keep]
                order = np.lexsort((f, o))
                f, w, o = f[order], w[order], o[order]
                out.append((f, w, o, _prefix(f, w, threshold)))
            yield pd.DataFrame({"node": b["node"], "size": b["size"]} | {c: [x[k] for x in out] for k, c in enumerate(("f", "w", "o", "prefix"))})

    return pool


_NODE = "node string, size long, f array<long>, w array<double>, o array<double>, prefix array<long>"


def pooled(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``nodes(node, size, f, w, o)`` in the global order and with their prefixes; rows of one node become their mean."""
    grouped = nodes.groupBy("node").agg(F.sum("size").alias("size"), F.collect_list(F.struct("size", "f", "w", "o")).alias("parts"))
    return grouped.mapInPandas(_pooled(threshold), _NODE)


def _tie(a: int, b: int) -> int:
    """A hash of a pair of node hashes, alike from both sides."""
    x = (a ^ b) * 0x9E3779B97F4A7C15 + (a + b) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1
    return ((x ^ x >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1) >> 2


def _choices(s: np.ndarray, tags: list[int], threshold: float) -> list[tuple[int, int, int, int]]:
    """(node, its best partner, step of their similarity, tie hash) for every row of a similarity matrix that has one."""
    out = []
    step = np.where(s >= threshold - 1e-9, np.floor(s / STEP + 1e-6), -1).astype(np.int64)
    np.fill_diagonal(step, -1)
    top = step.max(axis=1)
    for i in np.flatnonzero(top >= 0):
        ties = np.flatnonzero(step[i] == top[i])
        j = int(ties[0]) if len(ties) == 1 else max(map(int, ties), key=lambda j: (_tie(tags[i], tags[j]), tags[j]))
        out.append((int(i), j, int(top[i]), _tie(tags[i], tags[j])))
    return out


def _similarities(f: list[np.ndarray], w: list[np.ndarray]) -> np.ndarray:
    of, at = np.unique(np.concatenate(f), return_inverse=True)
    m = np.zeros((len(f), len(of)))
    m[np.repeat(np.arange(len(f)), [len(x) for x in f]), at] = np.concatenate(w)
    return m @ m.T


def _to_the_end(s: np.ndarray, sizes: np.ndarray, tags: list[int], threshold: float) -> list[int]:
    """The cluster of each node of a similarity matrix after all rounds, by its smallest row."""
    n = len(s)
    into, live, s, sizes = list(range(n)), np.arange(n), s.copy(), sizes.astype(float)
    while True:
        best = {i: j for i, j, _, _ in _choices(s[np.ix_(live, live)], [tags[i] for i in live], threshold)}
        pairs = [(int(live[i]), int(live[j])) for i, j in best.items() if i < j and best.get(j) == i]
        if not pairs:
            break
        for a, b in pairs:
            row = (sizes[a] * s[a] + sizes[b] * s[b]) / (sizes[a] + sizes[b])
            s[a], s[:, a] = row, row
            sizes[a] += sizes[b]
            into[b] = a
        gone = {b for _, b in pairs}
        live = np.array([i for i in live if i not in gone])
    for i in range(n):
        r = i
        while into[r] != r:
            r = into[r]
        into[i] = r
    return into


_CHOICE = "a string, b string, step long, tie long, done boolean"


def _compare(threshold: float) -> object:
    """Rows sorted by list and block: the best partner of every node of a block, or the clusters of a list that is linked to its end."""

    def group(rows: list[tuple]) -> list[tuple]:
        rows = list({r[0]: r for r in rows}.values())
        rows.sort(key=lambda r: r[0])
        alone = all(r[5] for r in rows)
        if len(rows) < 2:
            return [(rows[0][0], rows[0][0], -1, 0, True)] if alone else []
        f, w = [np.asarray(r[2]) for r in rows], [np.asarray(r[3]) for r in rows]
        s, tags = _similarities(f, w), [r[4] for r in rows]
        if alone:
            into = _to_the_end(s, np.array([r[1] for r in rows]), tags, threshold)
            return [(rows[i][0], rows[r][0], -1, 0, True) for i, r in enumerate(into)]
        return [(rows[i][0], rows[j][0], step, tie, False) for i, j, step, tie in _choices(s, tags, threshold)]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        last: tuple | None = None
        for b in batches:
            out: list[tuple] = []
            for key, x, y, *row in zip(*(b[c].tolist() for c in ("key", "x", "y", "node", "size", "f", "w", "tag", "alone")), strict=True):
                if (key, x, y) != last:
                    out += group(held) if held else []
                    held, last = [], (key, x, y)
                held.append(tuple(row))
            yield pd.DataFrame(out, columns=["a", "b", "step", "tie", "done"])
        if held:
            yield pd.DataFrame(group(held), columns=["a", "b", "step", "tie", "done"])

    return compare


def linkage(nodes: DataFrame, threshold: float = THRESHOLD, report: list[dict[str, int]] | None = None) -> DataFrame:
    """(node, cluster) of ``nodes(node, size, f, w, o, prefix)`` that have a candidate; average linkage of all mutual best pairs a round.

    ``report`` gets the nodes, the merges in place and the merges between lists of every round.
    """
    placed: DataFrame | None = None
    turn, every_pair = 0, False
    while True:
        live = stored(nodes)
        listed = live.select("node", F.explode("prefix").alias("key"))
        counts = listed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        # lists of one node have no pair; a node is alone in its list when that is all of its prefix and the list one block
        near = live.select("node", "size", "f", "w", F.xxhash64("node").alias("tag"), F.size("prefix").alias("k"), F.explode("prefix").alias("key")).join(counts, "key")
        p = F.ceil(F.col("n") / BLOCK)
        own = F.when(p > 1, F.pmod(F.xxhash64("node", F.lit(turn)), p)).otherwise(0).cast("long")
        dealt = near.withColumn("p", p).withColumn("own", own)
        if every_pair:
            dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p").cast("long") - 1)))
        else:
            dealt = dealt.withColumn("other", F.col("own"))
        dealt = dealt.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "size", "f", "w", "tag", ((F.col("k") == 1) & (F.col("p") == 1)).alias("alone"))
        ordered = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
        found = stored(ordered.mapInPandas(_compare(threshold), _CHOICE))
        done = found.where("done").select(F.col("a").alias("node"), F.col("b").alias("cluster"))
        best = found.where("not done").groupBy("a").agg(F.max_by("b", F.struct("step", "tie", "b")).alias("b"))
        pairs = best.alias("l").join(best.alias("r"), (F.col("l.b") == F.col("r.a")) & (F.col("r.b") == F.col("l.a"))).where("l.a < l.b")
        merged = cut(pairs.select(F.col("l.a").alias("cluster"), F.col("l.b").alias("node")))
        n = merged.count()
        if report is not None:
            report.append({"nodes": live.count(), "edges": best.count(), "in_place": done.where("node <> cluster").count(), "merges": n})
        step = done.unionByName(merged.select("node", "cluster"))
        if placed is None:
            placed = step
        else:
            renamed = step.select(F.col("node").alias("cluster"), F.col("cluster").alias("into"))
            placed = placed.join(renamed, "cluster", "left").select("node", F.coalesce("into", "cluster").alias("cluster")).unionByName(step)
        placed = stored(placed)
        large = counts.where(F.col("n") > BLOCK)
        if n == 0:
            if every_pair or large.isEmpty():
                return placed
            every_pair = True
        else:
            every_pair = False
        # nodes without a partner can get none, but those of a large list have not met all of it
        waiting = best.select(F.col("a").alias("node"))
        in_large = listed.join(large.select("key"), "key", "left_semi").select("node")
        going = live.join(waiting.unionByName(in_large).dropDuplicates(), "node", "left_semi")
        nodes = pooled(going.join(merged, "node", "left").withColumn("node", F.coalesce("cluster", "node")), threshold)
        turn += 1


def clustered(records: DataFrame, report: list[dict[str, int]] | None = None) -> DataFrame:
    """(dp_id, node, cluster): every record that may be in a cluster, once, with its report and the name of its cluster."""
    own = stored(profiles(records))
    found = linkage(vectors(own.select("node", "code", "names").dropDuplicates(["node"])), report=report)
    return own.select("dp_id", "node").dropDuplicates(["dp_id"]).join(found, "node", "left").select("dp_id", "node", F.coalesce("cluster", "node").alias("cluster"))


def _kept(rows: DataFrame) -> DataFrame:
    """(cluster, cluster_key, size) of clusters that are large enough."""
    return rows.groupBy("cluster").agg(F.min("dp_id").alias("cluster_key"), F.count("*").alias("size")).where(F.col("size") >= LEAST_SIZE)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every data point in a cluster."""
    rows = stored(clustered(table(spark, sf_dir, "data_points")).select("dp_id", "cluster"))
    return rows.join(_kept(rows), "cluster").select("cluster_key", "dp_id")


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster with its size and the members whose report is most usual in it."""
    rows = stored(clustered(table(spark, sf_dir, "data_points")))
    kept = _kept(rows)
    usual = rows.groupBy("cluster", "node").agg(F.count("*").alias("score"))
    scores = rows.join(kept.select("cluster"), "cluster", "left_semi").join(usual, ["cluster", "node"]).select("cluster", "dp_id", "score")
    # the best of each of some slices first, so that no task ranks a whole cluster
    order = [F.desc("score"), F.asc("dp_id")]
    sliced = Window.partitionBy("cluster", F.pmod(F.xxhash64("dp_id"), F.lit(64))).orderBy(*order)
    first = scores.withColumn("r", F.row_number().over(sliced)).where(F.col("r") <= TYPICAL).drop("r")
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(*order))).where(F.col("r") <= TYPICAL)
    typical = ranked.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "dp_id"))), lambda x: x["dp_id"]).alias("typical"))
    return kept.join(typical, "cluster").select("cluster_key", "size", "typical")


QUERIES = {"p5_found": p5_found, "p5_clusters": p5_clusters}
SQL: dict[str, str] = {}
