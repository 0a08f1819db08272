"""What enters the corpus: documents cut to chunks and data points, statements taken as they are, hypotheses, scenario files.

All take tables of many rows at once and merge them into the store by key, so that taking the same text in again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import corpus
from tessera.plans.settings import DEFAULTS, Settings
from tessera.sources.scenario import read_scenarios
from tessera.sources.store import Store

#: (doc_id, chunk_id, ord, text) to (doc_id, chunk_id, ord, pos, text).
Atomizer = Callable[[DataFrame], DataFrame]


def _meta(rows: DataFrame) -> F.Column:
    return F.coalesce(F.col("meta"), F.lit("{}")) if "meta" in rows.columns else F.lit("{}")


def add_documents(store: Store, rows: DataFrame, atomize: Atomizer = corpus.atoms_of, settings: Settings = DEFAULTS) -> DataFrame:
    """Take ``rows(name, text, meta)`` in: (doc_id, n_data_points) of each.

    A document is known by its name. Chunks and data points have its ``meta``; a data point is known by its text.
    """
    docs = rows.where("name is not null and text is not null").select(F.concat(F.lit("doc::"), T.content_id("name")).alias("doc_id"), "name", "text", _meta(rows).alias("meta")).dropDuplicates(["doc_id"])
    store.merge("documents", docs)
    meta = docs.select("doc_id", "meta")
    chunks = corpus.chunks_of(docs.select("doc_id", "text"), settings)
    store.merge("chunks", chunks.join(meta, "doc_id"))
    points = corpus.data_points_of(atomize(chunks.select("doc_id", "chunk_id", "ord", "text")))
    store.merge("data_points", points.join(meta, "doc_id").withColumn("prior", F.lit(None).cast("double")))
    n = points.groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_data_points"))


def add_atomic(store: Store, rows: DataFrame) -> DataFrame:
    """Take ``rows(text, meta)`` in, each as one data point of a document and chunk of its own: (doc_id, n_data_points)."""
    short = F.left(F.sha1(F.encode("text", "UTF-8")), F.lit(8))
    one = rows.where("text is not null").select("text", _meta(rows).alias("meta"), short.alias("h")).dropDuplicates(["h"])
    doc_id, chunk_id = F.concat(F.lit("doc::"), F.col("h")), F.concat(F.lit("chunk::"), F.col("h"))
    name = F.coalesce(F.get_json_object("meta", "$.source"), F.lit("atomic"))
    store.merge("documents", one.select(doc_id.alias("doc_id"), name.alias("name"), "text", "meta"))
    store.merge("chunks", one.select(chunk_id.alias("chunk_id"), doc_id.alias("doc_id"), "text", F.lit(0).alias("ord"), "meta"))
    store.merge("data_points", one.select(T.content_id("text").alias("dp_id"), chunk_id.alias("chunk_id"), doc_id.alias("doc_id"), T.stripped("text").alias("text"), "meta", F.lit(None).cast("double").alias("prior")))
    return one.select(doc_id.alias("doc_id"), F.lit(1).cast("long").alias("n_data_points"))


def add_episodes(store: Store, rows: DataFrame, atomize: bool = True) -> DataFrame:
    """Take episodes ``rows(text, meta)`` in: named by their source and divided, or as they are when they are single statements."""
    if not atomize:
        return add_atomic(store, rows)
    return add_documents(store, rows.select(F.coalesce(F.get_json_object(_meta(rows), "$.source"), F.lit("episode")).alias("name"), "text", _meta(rows).alias("meta")))


def add_hypotheses(store: Store, rows: DataFrame) -> DataFrame:
    """Take ``rows(text, context_summary, meta)`` in: (hyp_id, text)."""
    context = T.stripped(F.coalesce("context_summary", F.lit(""))) if "context_summary" in rows.columns else F.lit("")
    hyps = rows.where("text is not null").select(T.content_id("text").alias("hyp_id"), T.stripped("text").alias("text"), context.alias("context_summary"), _meta(rows).alias("meta")).dropDuplicates(["hyp_id"])
    store.merge("hypotheses", hyps)
    return hyps.select("hyp_id", "text")


def load_scenario(store: Store, paths: list[Path], index: int) -> tuple[int, int]:
    """Take the scenario at a place of the list in: the numbers of its episodes and hypotheses. An IndexError outside of the list."""
    if not 0 <= index < len(paths):
        raise IndexError(f"scenario index out of range (0..{len(paths) - 1})")
    episodes, claims = read_scenarios(store.spark, [paths[index]])
    add_atomic(store, episodes.select("text", "meta"))
    add_hypotheses(store, claims.select("text", "context_summary"))
    return episodes.count(), claims.count()
