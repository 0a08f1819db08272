"""A mix of sources to target weights: exact block quotas, split over shards by a multivariate-hypergeometric tree.

Every source's documents lie in blocks (by hash, a bounded number a source). A source's quota of tokens is drawn as
whole passes over its permuted blocks plus part of a further pass, the last block by its documents. The draws of all sources
are dealt to output shards by recursive halving: how many of each source's go left is a multivariate-hypergeometric
draw, so every shard is a fair sample of the mix, exact in sum, and no block is drawn twice in a pass. Within a shard
the documents are shuffled locally.

The size of the mix is the largest at which the sources with documents reach their shares within their repeats. Where that is
less than the text there is, the sources that run out first are let fall short, with all their repeats used, until the mix is
as large as the text or the sources that are met would have less than ``min_met`` of the share. Sources without documents
cannot be met; the others keep their proportions, and the report has the shares reached.

Defined results for odd input: sources are compared trimmed, in lower case, with blanks and hyphens as underscores;
null sources, ids and texts take no part; of repeated targets of a source the largest holds; null or non-positive
shares and repeats below 1 are skipped; repeated rows of an id are one document; empty tables give an empty mix; further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import TOKENIZER_DIR, token_sizes
from tessera.plans.shared import stored, table

#: Blocks of a source: so many, or so many a shard where there are more shards; bounds what the driver plans with, whatever the size of the source.
BLOCKS, SHARD_BLOCKS = 512, 4
#: Output shards: at least so many, and so many more that a shard holds about this many tokens and fits a task.
SHARDS, SHARD_TOKENS, MOST_SHARDS = 32, 50_000_000, 8_192
_SEED = 4_127
#: Share of the registered mix that is met whatever the size; sources with the rest together don't bound it.
MIN_MET = 0.9


def source_name(col: str) -> Column:
    return F.regexp_replace(F.lower(F.trim(col)), r"[\s-]+", "_")


def targets_of(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Source to (share, repeats); the table is fixed and small."""
    rows = targets.select(source_name("source").alias("s"), "target_share", "max_repeats").where("s is not null and target_share > 0 and max_repeats >= 1").collect()
    found: dict[str, tuple[float, int]] = {}
    for r in sorted(rows):
        found[r.s] = max(found.get(r.s, (0.0, 0)), (float(r.target_share), int(r.max_repeats)))
    return found


def mix_size(available: dict[str, int], targets: dict[str, tuple[float, int]], min_met: float = 1.0) -> float:
    """The largest total at which every source present is met within its repeats, or without those that would keep the mix smaller than the text.

    Sources of at least ``min_met`` of the share present are always met.
    """
    present = sorted((available[s] * rep / share, share) for s, (share, rep) in targets.items() if available.get(s))
    whole, text, short = sum(share for _, share in present), sum(available[s] for s in targets if available.get(s)), 0.0
    for total, share in present:
        short += share
        if total * whole >= text or short > (1 - min_met) * whole + 1e-12:
            return total
    return present[-1][0] if present else 0.0


def split_tree(draws: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Draws per source dealt to shards: a (shards, sources) array of counts with the given column sums."""
    if shards == 1:
        return draws[None, :]
    left = shards // 2
    total = int(draws.sum())
    # the multivariate-hypergeometric draw of the left half's share, source by source
    take, rest, pool = np.zeros_like(draws), total * left // shards, total
    for i, n in enumerate(draws):
        pool -= int(n)
        take[i] = rng.hypergeometric(int(n), pool, rest) if rest and n + pool else 0
        rest -= int(take[i])
    return np.concatenate([split_tree(take, left, rng), split_tree(draws - take, shards - left, rng)])


def shards_of(total: float) -> int:
    return min(MOST_SHARDS, max(SHARDS, math.ceil(total / SHARD_TOKENS)))


def plan(blocks: pd.DataFrame, targets: dict[str, tuple[float, int]], min_met: float = 1.0, shards: int | None = None) -> pd.DataFrame:
    """The draws: (source, block, repeat_no, shard, budget); budget is null for a whole block, else the tokens to take of it.

    ``blocks`` is (source, block, tokens), a bounded number of rows a source.
    """
    rng = np.random.default_rng(_SEED)
    available = {str(s): int(t) for s, t in blocks.groupby("source")["tokens"].sum().items()}
    total = mix_size(available, targets, min_met)
    shards = shards or shards_of(total)
    present = sum(share for s, (share, _) in targets.items() if available.get(s))
    rows: list[tuple[str, int, int, float | None]] = []
    names = [s for s in targets if available.get(s)]
    counts = []
    for s in names:
        share, repeats = targets[s]
        quota = min(total * share, float(available[s] * repeats)) if present else 0.0
        own = blocks[(blocks["source"] == s) & (blocks["tokens"] > 0)].sort_values("block")
        drawn = 0
        for epoch in range(repeats):
            for k in rng.permutation(len(own)):
                tokens = int(own["tokens"].iat[k])
                if quota < 0.5:
                    break
                rows.append((s, int(own["block"].iat[k]), epoch, None if tokens <= quota else quota))
                quota -= tokens
                drawn += 1
        counts.append(drawn)
    if not rows:
        return pd.DataFrame({"source": [], "block": [], "repeat_no": [], "shard": [], "budget": []})
    dealt = split_tree(np.array(counts, dtype=np.int64), shards, rng)
    out = pd.DataFrame(rows, columns=["source", "block", "repeat_no", "budget"])
    shard = np.concatenate([rng.permutation(np.repeat(np.arange(shards), dealt[:, i])) for i in range(len(names))])
    return out.assign(shard=shard)


def mix(documents: DataFrame, targets: dict[str, tuple[float, int]], min_met: float = 1.0, shards: int | None = None, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(shard, position, doc_id, source, repeat_no, tokens) of the mix."""
    spark = documents.sparkSession
    wanted = documents.where("doc_id is not null and text is not null").select("doc_id", source_name("source").alias("source"), "text").where(F.col("source").isin(*targets))
    sized = token_sizes(wanted, "source", folder=folder).groupBy("doc_id").agg(F.max_by(F.struct("source", "tokens"), "tokens").alias("x")).select("doc_id", "x.source", "x.tokens")
    docs = stored(sized)
    available = {r.source: r.tokens for r in docs.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    shards = shards or shards_of(mix_size(available, targets, min_met))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(_SEED)), F.lit(max(BLOCKS, SHARD_BLOCKS * shards))))
    blocks = docs.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")).toPandas()
    draws = plan(blocks, targets, min_met, shards)
    schema = "source string, block long, repeat_no int, shard int, budget double"
    # at most sources x blocks x repeats rows, the blocks bounded by MOST_SHARDS: the bound of what is broadcast
    planned = spark.createDataFrame([(r.source, int(r.block), int(r.repeat_no), int(r.shard), None if math.isnan(r.budget) else float(r.budget)) for r in draws.astype({"budget": float}).itertuples()], schema)
    taken = docs.join(F.broadcast(planned), ["source", "block"])
    part = taken.where("budget is not null")
    in_block = Window.partitionBy("source", "block", "repeat_no").orderBy(F.xxhash64("doc_id", "repeat_no"), "doc_id")
    # the document that crosses the budget is taken when that comes nearer to it
    reach = F.sum("tokens").over(in_block)
    part = part.withColumn("reach", reach).where(F.col("reach") - F.col("tokens") / 2 <= F.col("budget")).drop("reach")
    rows = taken.where("budget is null").unionByName(part)
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64("doc_id", "repeat_no", F.lit(_SEED)), "doc_id", "repeat_no")
    return rows.select("shard", (F.row_number().over(shuffled) - 1).alias("position"), "doc_id", "source", "repeat_no", "tokens")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix, by shard and position."""
    return mix(table(spark, sf_dir, "documents"), targets_of(table(spark, sf_dir, "mix_targets")), MIN_MET)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: the target, the share reached, and the greatest number of times a document is used."""
    targets = targets_of(table(spark, sf_dir, "mix_targets"))
    rows = p9_mix(spark, sf_dir)
    uses = rows.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("tokens").alias("tokens"))
    reached = uses.groupBy("source").agg(F.count("*").alias("n_docs"), F.max("uses").alias("most_uses"), F.sum("tokens").alias("tokens"))
    asked = spark.createDataFrame([(s, share, rep) for s, (share, rep) in targets.items()], "source string, target_share double, max_repeats int")
    # one row a target: the window over all of them is as small as the table of targets
    joined = asked.join(reached, "source", "left").withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy()))
    zero = F.lit(0).cast("long")
    return joined.select("source", "target_share", "max_repeats", F.coalesce("n_docs", zero).alias("n_docs"), F.coalesce("most_uses", zero).alias("most_uses"), F.coalesce("tokens", zero).alias("tokens"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share"))


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
