"""Orphan references: keys that point at absent, deleted or later rows of another table.

Plan: the foreign keys are aggregated to one row each (map-side combine, so a key that a third of all rows
refer to costs one row per map task), joined against the aggregated parent keys and tombstones, and reduced to the
*suspect* keys. A left anti-join finds the missing ones. Only referring rows of suspect keys are read back.

Defined results for odd input: null and blank references are no cases; a null time is never late (and gives a null
period); a null in another part of a row key counts as empty text; rows that repeat give one case; empty tables
give no cases (an empty parent table makes every reference ``missing``); further columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.shared import table


@dataclass(frozen=True)
class Reference:
    """A column of ``tbl`` that refers to ``target_key`` of ``target``."""

    tbl: str
    column: str
    row_key: tuple[str, ...]
    time: str
    target: str
    target_key: str
    target_time: str


REFERENCES = (
    Reference("lift_cache", "dp_id", ("hyp_id", "dp_id", "model"), "scored_at", "data_points", "dp_id", "written_at"),
    Reference("data_points", "chunk_id", ("dp_id",), "written_at", "chunks", "chunk_id", "written_at"),
    Reference("data_points", "doc_id", ("dp_id",), "written_at", "documents", "doc_id", "ingested_at"),
)


def _key_text(parts: tuple[str, ...]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])


def suspect_keys(refs: DataFrame, parents: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Keys of ``refs(v, t)`` with a case, as (v, kind, arrived); ``late`` ones still need each row's own time.

    ``parents`` is (v, t), ``tombstones`` (v, deleted_at).
    """
    keys = refs.groupBy("v").agg(F.min("t").alias("first_ref"))
    parent = parents.where(F.col("v").isNotNull()).groupBy("v").agg(F.min("t").alias("arrived"), F.max("t").alias("last_arrived"))
    gone = tombstones.where(F.col("v").isNotNull()).groupBy("v").agg(F.max("deleted_at").alias("deleted_at"))
    missing = keys.join(parent, "v", "left_anti").join(gone, "v", "left").select("v", F.when(F.col("deleted_at").isNotNull(), "deleted").otherwise("missing").alias("kind"), F.lit(None).cast("timestamp_ntz").alias("arrived"))
    present = keys.join(parent, "v").join(gone, "v", "left")
    deleted = F.col("deleted_at").isNotNull() & ~F.coalesce(F.col("last_arrived") > F.col("deleted_at"), F.lit(False))
    odd = present.select("v", F.when(deleted, "deleted").when(F.col("arrived") > F.col("first_ref"), "late").alias("kind"), F.col("arrived").cast("timestamp_ntz")).where("kind is not null")
    return missing.unionByName(odd)


def orphans(tables: dict[str, DataFrame], references: tuple[Reference, ...] = REFERENCES) -> DataFrame:
    """One row per referring key and value with a case: (tbl, ref_column, row_key, ref_value, kind, referred_at)."""
    found: DataFrame | None = None
    for r in references:
        value = F.col(r.column).cast("string")
        refs = tables[r.tbl].select(_key_text(r.row_key).alias("row_key"), value.alias("v"), F.col(r.time).cast("timestamp_ntz").alias("t")).where(F.length(F.trim("v")) > 0)
        parents = tables[r.target].select(F.col(r.target_key).cast("string").alias("v"), F.col(r.target_time).cast("timestamp_ntz").alias("t"))
        gone = tables["tombstones"].where(F.col("tbl") == r.target).select(F.col("key").alias("v"), F.col("deleted_at").cast("timestamp_ntz").alias("deleted_at"))
        suspects = suspect_keys(refs, parents, gone)
        rows = (
            refs.join(suspects, "v")
            .groupBy("row_key", "v")
            .agg(F.min("t").alias("referred_at"), F.first("kind").alias("kind"), F.first("arrived").alias("arrived"))
            .where((F.col("kind") != "late") | (F.col("arrived") > F.col("referred_at")))
            .select(F.lit(r.tbl).alias("tbl"), F.lit(r.column).alias("ref_column"), "row_key", F.col("v").alias("ref_value"), "kind", "referred_at")
        )
        found = rows if found is None else found.unionByName(rows)
    assert found is not None
    return found


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: table(spark, sf_dir, t) for t in ("documents", "chunks", "data_points", "lift_cache", "tombstones")}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every orphan reference of the corpus."""
    return orphans(_tables(spark, sf_dir)).drop("referred_at")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, column, kind and month of the (earliest) referring row."""
    month = F.date_format("referred_at", "yyyy-MM").alias("month")
    return orphans(_tables(spark, sf_dir)).groupBy("tbl", "ref_column", "kind", month).agg(F.count("*").alias("n_refs"), F.countDistinct("ref_value").alias("n_keys"))


def _sql_of(r: Reference) -> str:
    key = " || '|' || ".join(f"coalesce(cast({p} as varchar), '')" for p in r.row_key)
    return f"""
      select '{r.tbl}' tbl, '{r.column}' ref_column, q.row_key, q.v ref_value, q.t referred_at,
        case when d.deleted_at is not null and (p.mx is null or p.mx <= d.deleted_at) then 'deleted'
             when p.v is null then 'missing'
             when p.mn > q.t then 'late' end kind
      from (select {key} row_key, cast({r.column} as varchar) v, min({r.time}) t from {r.tbl}
            where length(trim(cast({r.column} as varchar))) > 0 group by all) q
      left join (select cast({r.target_key} as varchar) v, min({r.target_time}) mn, max({r.target_time}) mx
                 from {r.target} group by 1) p on p.v = q.v
      left join (select key v, max(deleted_at) deleted_at from tombstones where tbl = '{r.target}' group by 1) d on d.v = q.v"""


_ALL = " union all ".join(_sql_of(r) for r in REFERENCES)

QUERIES = {"p3_found": p3_found, "p3_report": p3_report}
SQL = {
    "p3_found": f"select tbl, ref_column, row_key, ref_value, kind from ({_ALL}) where kind is not null",
    "p3_report": f"""select tbl, ref_column, kind, strftime(referred_at, '%Y-%m') "month", count(*) n_refs, count(distinct ref_value) n_keys
                     from ({_ALL}) where kind is not null group by all""",
}
