"""Where tables live: parquet folders with an upsert, JSON and CSV feeds, and SQLite files of an older store.

A write goes to a folder of its own and the table then points to it, so a reader never sees half a write and a lost executor only
repeats its task.
"""

from __future__ import annotations

import json
import sqlite3
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.corpus import last_written, upsert

CORPUS = {
    "documents": "doc_id string, name string, text string, meta string",
    "chunks": "chunk_id string, doc_id string, text string, ord int, meta string",
    "data_points": "dp_id string, chunk_id string, doc_id string, text string, meta string, prior double",
    "hypotheses": "hyp_id string, text string, context_summary string, meta string",
}
CACHES = {
    "lift_cache": "hyp_id string, dp_id string, model string, change string, lift double, log_lift double, relatedness double, verdict string, rationale string",
    "joint_cache": "hyp_id string, set_key string, model string, change string, lift double, why string",
    "prior_cache": "dp_id string, model string, prior double",
}
KEYS = {"documents": ["doc_id"], "chunks": ["chunk_id"], "data_points": ["dp_id"], "hypotheses": ["hyp_id"], "lift_cache": ["hyp_id", "dp_id", "model"], "joint_cache": ["hyp_id", "set_key", "model"], "prior_cache": ["dp_id", "model"]}


#: Merges that stay beside a version of a table before they are folded into a new one.
MOST_DELTAS = 16


class Store:
    """Parquet tables in a folder that all executors share: a version and the merges since.

    The pointer of a table, a file written through Hadoop's file system, names the version and the number of its merges. A merge
    writes its own rows only; readers take the last row of a key. After ``MOST_DELTAS`` merges the next one folds them into a new version.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):  # noqa: ANN202 - a Java object
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):  # noqa: ANN202 - a Java object
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _state(self, name: str) -> tuple[int, int]:
        """The version of a table and its merges."""
        fs, path = self._fs(), self._path(name, "CURRENT")
        if not fs.exists(path):
            return 0, 0
        stream = fs.open(path)
        try:
            at = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return at["version"], at["deltas"]

    def _point(self, name: str, version: int, deltas: int) -> None:
        fs, part = self._fs(), self._path(name, f"CURRENT.{uuid.uuid4().hex}")
        stream = fs.create(part, True)
        try:
            stream.write(bytearray(json.dumps({"version": version, "deltas": deltas}).encode()))
        finally:
            stream.close()
        current = self._path(name, "CURRENT")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        overwrite[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(part, current, overwrite)

    def read(self, name: str) -> DataFrame:
        """The table as it is now; an empty one of the right columns before the first write."""
        version, deltas = self._state(name)
        schema = (CORPUS | CACHES)[name]
        if not version and not deltas:
            return self.spark.createDataFrame([], schema)
        base = self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v{version}") if version else self.spark.createDataFrame([], schema)
        if not deltas:
            return base
        rows = base.withColumn("_merge", F.lit(0))
        for k in range(1, deltas + 1):
            rows = rows.unionByName(self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v{version}-{k}").withColumn("_merge", F.lit(k)))
        return last_written(rows, KEYS[name], ["_merge"]).drop("_merge")

    def write(self, name: str, rows: DataFrame) -> None:
        """A new version of the table."""
        version = self._state(name)[0] + 1
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/v{version}")
        self._point(name, version, 0)

    def merge(self, name: str, new: DataFrame) -> None:
        """Insert or replace by key. Cells and joint lifts whose ``status`` is not ok are not kept."""
        if "status" in new.columns:
            new = new.where("status = 'ok'")
        version, deltas = self._state(name)
        known = self.read(name)
        rows = new.select(known.columns).dropDuplicates(KEYS[name])
        if deltas >= MOST_DELTAS:
            self.write(name, upsert(known, rows, KEYS[name]))
            return
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/v{version}-{deltas + 1}")
        self._point(name, version, deltas + 1)

    def clear_corpus(self) -> None:
        """Empty the corpus; the caches stay, as they are keyed by content."""
        for name in CORPUS:
            self.write(name, self.spark.createDataFrame([], CORPUS[name]))

    def clear_all(self) -> None:
        self.clear_corpus()
        for name in CACHES:
            self.write(name, self.spark.createDataFrame([], CACHES[name]))


def read_json(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A feed of JSON lines with the columns of a corpus table; further fields are passed over."""
    return spark.read.schema((CORPUS | CACHES)[name]).json(path)


def read_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema((CORPUS | CACHES)[name]).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_sqlite(spark: SparkSession, path: str, name: str, splits: int = 8) -> DataFrame:
    """A table of a SQLite file that all executors can open, read in ranges of row ids."""
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        lo, hi = con.execute(f'select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from "{name}"').fetchone()
        columns = [r[1] for r in con.execute(f'pragma table_info("{name}")')]
        kinds = {r[1]: {"INTEGER": "long", "REAL": "double"}.get(r[2].upper(), "string") for r in con.execute(f'pragma table_info("{name}")')}
    finally:
        con.close()
    step = max(1, -(-(hi - lo + 1) // splits))
    ranges = [(a, min(hi, a + step - 1)) for a in range(lo, hi + 1, step)]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    if not ranges:
        return spark.createDataFrame([], schema)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        try:
            for b in batches:
                for a, z in zip(b["a"], b["z"], strict=True):
                    yield pd.read_sql_query(f'select * from "{name}" where rowid between {int(a)} and {int(z)}', own)[columns]
        finally:
            own.close()

    return spark.createDataFrame(ranges, "a long, z long").repartition(len(ranges)).mapInPandas(rows, schema)
