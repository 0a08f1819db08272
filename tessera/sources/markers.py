"""Whether the files of a source tree hold the strings that they must: a check that a checkout is whole and of one version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def body_of(source: Column, function: str) -> Column:
    """The text of a Python function or method in a file: from its ``def`` to the next line that is not further in; empty without one."""
    return F.regexp_extract(source, rf"(?m)^([ \t]*)(?:async[ \t]+)?def[ \t]+{function}\b.*(?:\n(?:\1[ \t]+.*|[ \t]*$))*", 0)


def marked(spark: SparkSession, folder: str, markers: list[tuple[str, str | None, str]], pattern: str = "*.py") -> DataFrame:
    """(file, function, marker, found) of ``markers``: a file by the end of its path, the function to look in (null: the whole file), the string.

    A file that is not there has none of its strings.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    wanted = spark.createDataFrame(markers, "file string, function string, marker string")
    found = None
    for name in sorted({f for _, f, _ in markers if f}) or [None]:
        own = wanted.where(F.col("function") == name if name else F.lit(False))
        part = own.join(files, files["path"].endswith(own["file"]), "left").select("file", "function", "marker", body_of(F.col("value"), name or "").contains(F.col("marker")).alias("hit"))
        found = part if found is None else found.unionByName(part)
    whole = wanted.where("function is null")
    found = found.unionByName(whole.join(files, files["path"].endswith(whole["file"]), "left").select("file", "function", "marker", F.col("value").contains(F.col("marker")).alias("hit")))
    return found.groupBy("file", "function", "marker").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("found"))
