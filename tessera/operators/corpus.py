"""The corpus as tables: live rows of a log of writes, documents to chunks to atoms, content-addressed data points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.vectors import bucket, hash_tokens
from tessera.plans.settings import DEFAULTS, Settings
from tessera.plans.shared import spread


def last_written(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key of a log of writes, by ``order`` (nulls first), without a sort of whole keys.

    The aggregate combines before the shuffle, so a key that a third of all rows have is one row per map task.
    """
    rest = [c for c in log.columns if c not in key]
    # a null sorts before any value within a struct, as the earliest write should
    last = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order], F.xxhash64(*rest))).alias("x")
    return log.groupBy(*key).agg(last).select(*key, *[F.col(f"x.{c}").alias(c) for c in rest]).select(log.columns)


def live(rows: DataFrame, tombstones: DataFrame, tbl: str, key: str, time: str) -> DataFrame:
    """Rows that no later tombstone of their key deletes."""
    gone = tombstones.where(F.col("tbl") == tbl).groupBy(F.col("key").alias("_key")).agg(F.max("deleted_at").alias("_deleted_at"))
    joined = rows.withColumn("_key", F.col(key).cast("string")).join(gone, "_key", "left")
    return joined.where(F.col("_deleted_at").isNull() | F.coalesce(F.col(time) > F.col("_deleted_at"), F.lit(False))).select(rows.columns)


def sentence_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, sentence)."""
    return documents.select("doc_id", F.posexplode(T.simple_sentences("text")).alias("pos", "sentence"))


def _counted(ordered: F.Column, distinct: F.Column) -> F.Column:
    """(k, n): the distinct buckets of a sentence and how many of its words fall into each, by the places at which they begin in order."""
    places = F.transform(distinct, lambda k: F.array_position(ordered, k))
    return F.struct(distinct.alias("k"), places.alias("p"), (F.size(ordered) + 1).cast("long").alias("end"))


def _product(a: F.Column, b: F.Column) -> F.Column:
    own = F.arrays_zip(a["k"].alias("k"), a["n"].alias("n"))
    return F.aggregate(own, F.lit(0.0), lambda s, x: s + x["n"] * F.coalesce(F.get(b["n"], F.array_position(b["k"], x["k"]) - 1), F.lit(0.0)))


def sentence_gaps(documents: DataFrame) -> DataFrame:
    """(doc_id, sentences, sims): a document's sentences and the cosines of the hashed words of each with the next one's, in one row.

    Nothing is shuffled but texts that a scan packs into few splits: a document's sentences stay in its row. Cosines are rounded, as thresholds compare them.
    """
    split = spread(documents.where("text is not null").select("doc_id", "text")).select("doc_id", T.simple_sentences("text").alias("sentences"))
    hashed = split.withColumn("_b", F.transform("sentences", lambda x: F.transform(hash_tokens(x), bucket)))
    ordered = hashed.withColumn("_s", F.transform("_b", lambda b: F.sort_array(b))).withColumn("_k", F.transform("_s", lambda s: F.array_distinct(s)))
    placed = ordered.withColumn("_p", F.zip_with("_s", "_k", _counted))
    each = lambda c: F.transform(c["p"], lambda v, i: (F.coalesce(F.get(c["p"], i + 1), c["end"]) - v).cast("double"))
    counted = placed.withColumn("_c", F.transform("_p", lambda c: F.struct(c["k"].alias("k"), each(c).alias("n"))))
    normed = counted.withColumn("_n", F.transform("_c", lambda c: F.sqrt(F.aggregate(c["n"], F.lit(0.0), lambda s, x: s + x * x))))

    def cosine(i: F.Column) -> F.Column:
        both = F.get("_n", i - 1) * F.get("_n", i)
        return F.round(F.when(both > 0, _product(F.get("_c", i - 1), F.get("_c", i)) / both).otherwise(0.0), 6)

    n = F.size("sentences")
    sims = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), cosine)).otherwise(F.array().cast("array<double>"))
    return normed.select("doc_id", "sentences", sims.alias("sims"))


def adjacent_similarity(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, sim): the cosine of each sentence with the next one."""
    # an outer generator: of another the optimiser would make a filter that computes the similarities again
    return sentence_gaps(documents).select("doc_id", F.posexplode_outer("sims").alias("pos", "sim")).where("pos is not null")


def _threshold(sims: F.Column, share: float) -> F.Column:
    """The exact percentile of an array, interpolated; null for an empty one."""
    ordered, at = F.sort_array(sims), (F.size(sims) - 1) * F.lit(share)
    low = F.floor(at).cast("int")
    lower = F.get(ordered, low)
    return lower + (F.get(ordered, F.least(low + 1, F.size(sims) - 1)) - lower) * (at - low)


def trough_thresholds(documents: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(doc_id, threshold) of documents of more than one sentence."""
    return sentence_gaps(documents).where(F.size("sentences") > 1).select("doc_id", _threshold(F.col("sims"), settings.chunk_percentile).alias("threshold"))


def fold_chunks(sims: F.Column, threshold: F.Column, settings: Settings) -> F.Column:
    """The positions at which the chunks of a document begin, for any minimum of sentences: a fold over its similarities."""
    start = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(1).alias("n"), F.lit(0).alias("pos"))

    def step(acc: F.Column, sim: F.Column) -> F.Column:
        cut = (acc["n"] >= settings.chunk_min_sentences) & ((sim <= threshold) | (acc["n"] >= settings.chunk_max_sentences))
        at = acc["pos"] + 1
        return F.struct(F.when(cut, F.concat(acc["starts"], F.array(at))).otherwise(acc["starts"]).alias("starts"), F.when(cut, 1).otherwise(acc["n"] + 1).alias("n"), at.alias("pos"))

    return F.aggregate(sims, start, step, lambda acc: acc["starts"])


def _run_starts(sims: F.Column, threshold: F.Column, settings: Settings) -> F.Column:
    """The same for a minimum of one, where every trough cuts: the runs between troughs, split evenly by count, without a fold."""
    at = F.sequence(F.lit(1), F.size(sims))
    troughs = F.when(F.size(sims) > 0, F.filter(at, lambda i: F.get(sims, i - 1) <= threshold)).otherwise(F.array().cast("array<int>"))
    first = F.concat(F.array(F.lit(0)), troughs)
    ends = F.concat(troughs, F.array(F.size(sims) + 1))
    return F.flatten(F.zip_with(first, ends, lambda a, b: F.sequence(a, b - 1, F.lit(settings.chunk_max_sentences))))


def chunks_of(documents: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(doc_id, chunk_id, ord, n_sentences, text): chunks end at troughs of similarity and after ``chunk_max_sentences``, never before ``chunk_min_sentences``."""
    rows = sentence_gaps(documents).where(F.size("sentences") > 0).withColumn("threshold", _threshold(F.col("sims"), settings.chunk_percentile))
    starts = (_run_starts if settings.chunk_min_sentences <= 1 else fold_chunks)(F.col("sims"), F.col("threshold"), settings)
    placed = rows.select("doc_id", "sentences", starts.alias("starts"))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("sentences")))
    spans = placed.select("doc_id", "sentences", F.posexplode_outer(F.arrays_zip(F.col("starts").alias("a"), ends.alias("b"))).alias("ord", "x"))
    text = F.array_join(F.slice("sentences", F.col("x.a") + 1, F.col("x.b") - F.col("x.a")), " ")
    chunk_id = F.concat_ws("::c", F.col("doc_id").cast("string"), F.col("ord").cast("string"))
    return spans.select("doc_id", chunk_id.alias("chunk_id"), "ord", (F.col("x.b") - F.col("x.a")).cast("long").alias("n_sentences"), text.alias("text"))


def atoms_of(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, ord, pos, text): the lexical oracle's atoms of each chunk, each once a chunk."""
    found = chunks.select("doc_id", "chunk_id", "ord", F.posexplode(T.kept_atoms(T.oracle_atoms("text"))).alias("pos", "text"))
    return found


def data_points_of(atoms: DataFrame) -> DataFrame:
    """(dp_id, chunk_id, doc_id, text): atoms by content; the last place they occur at wins."""
    named = atoms.withColumn("dp_id", T.content_id("text"))
    last = F.max_by(F.struct("chunk_id", "doc_id", "text"), F.struct("doc_id", "ord", "pos")).alias("x")
    return named.groupBy("dp_id").agg(last).select("dp_id", "x.chunk_id", "x.doc_id", "x.text")


def upsert(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those of ``existing`` with their key, and the rest of ``existing``."""
    return existing.join(new.select(key).dropDuplicates(), key, "left_anti").unionByName(new)
