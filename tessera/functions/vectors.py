"""Embeddings: a hashing embedder in column functions, precomputed vectors, TF-IDF by group, and model embedders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scale import col_of


def hash_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col_of(text)), F.lit("[a-z0-9]+"), F.lit(0))


def bucket(token: Column | str) -> Column:
    """The last byte of the token's MD5: 256 buckets."""
    return F.conv(F.right(F.md5(F.encode(col_of(token), "UTF-8")), F.lit(2)), 16, 10).cast("int")


def sparse_hashing(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, bucket, weight): unit vectors of hashed words in sparse form, one row per bucket that is not zero."""
    words = rows.select(*keys, F.explode(hash_tokens(text)).alias("token")).select(*keys, bucket("token").alias("bucket"))
    counts = words.groupBy(*keys, "bucket").agg(F.count("*").cast("double").alias("tf"))
    norms = counts.groupBy(*keys).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    return counts.join(norms, keys).select(*keys, "bucket", (F.col("tf") / F.col("norm")).alias("weight"))


def sparse_tfidf(rows: DataFrame, group: str, keys: list[str], text: str, stop: tuple[str, ...] = ()) -> DataFrame:
    """(group, keys, term, weight): TF-IDF within groups of any size in sparse form, as ``tfidf_matrix`` has it for one group in memory."""
    found = F.filter(F.regexp_extract_all(F.lower(col_of(text)), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda w: ~w.isin(*stop)) if stop else F.regexp_extract_all(F.lower(col_of(text)), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    tf = rows.select(group, *keys, F.explode(found).alias("term")).groupBy(group, *keys, "term").agg(F.count("*").cast("double").alias("tf"))
    df = tf.groupBy(group, "term").agg(F.count("*").alias("df"))
    n = rows.groupBy(group).agg(F.count("*").alias("n_texts"))
    weighed = tf.join(df, [group, "term"]).join(n, group).withColumn("x", F.col("tf") * (F.log((1 + F.col("n_texts")) / (1 + F.col("df"))) + 1))
    norms = weighed.groupBy(group, *keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return weighed.join(norms, [group, *keys]).select(group, *keys, "term", (F.col("x") / F.col("norm")).alias("weight"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col_of(a), col_of(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str) -> Column:
    """The vector at length one; a zero vector stays zero."""
    n = F.coalesce(F.nullif(norm(a), F.lit(0.0)), F.lit(1.0))
    return F.transform(col_of(a), lambda x: x.cast("double") / n)


def hash_matrix(texts: list[str], dim: int = 256) -> np.ndarray:
    """The hashing embedder over a batch, for stages that need dense rows."""
    import hashlib
    import re

    seen: dict[str, int] = {}
    words = [re.findall(r"[a-z0-9]+", (t or "").lower()) for t in texts]
    for own in words:
        for w in own:
            if w not in seen:
                seen[w] = int(hashlib.md5(w.encode(), usedforsecurity=False).hexdigest(), 16) % dim
    at = np.array([seen[w] for own in words for w in own], dtype=np.int64)
    at += np.repeat(np.arange(len(texts)), [len(own) for own in words]) * dim
    out = np.bincount(at, minlength=len(texts) * dim).reshape(len(texts), dim).astype(float)
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n == 0, 1, n)


def tfidf_matrix(texts: list[str], stop: tuple[str, ...] = ()) -> np.ndarray:
    """TF-IDF rows of one group (smoothed idf plus one, unit length); fewer than two texts give ones."""
    import re

    if len(texts) < 2:
        return np.ones((len(texts), 1))
    bags = [[w for w in re.findall(r"\b\w\w+\b", (t or "").lower()) if w not in stop] for t in texts]
    names = {w: i for i, w in enumerate(sorted({w for b in bags for w in b}))}
    if not names:
        return np.zeros((len(texts), 1))
    tf = np.zeros((len(texts), len(names)))
    for i, b in enumerate(bags):
        for w in b:
            tf[i, names[w]] += 1
    idf = np.log((1 + len(texts)) / (1 + (tf > 0).sum(axis=0))) + 1
    x = tf * idf
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def model_embeddings(rows: DataFrame, text: str, out: str, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """``rows`` with unit vectors of a model that each worker loads once by ``load``."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for b in it:
            v = np.asarray(encode(list(b[text])), dtype=float)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            yield b.assign(**{out: list(v / np.where(n == 0, 1, n))})

    return rows.mapInPandas(batches, schema)
