"""Records that are the same but for layout: canonical form, 128-bit hash, map-side combined counts.

Two texts are copies when they have the same words in the same order after full case folding, compatibility
normalisation, dropping invisible characters and treating everything but letters, marks and digits as a word break.
A point or comma between digits belongs to the figure. In a text of three or more ``name: value`` (or ``name =
value``) fields divided by ``;`` or ``|`` the order of the fields does not count.

Defined results for odd input: a row with null id or null text is no record; an empty text and a text without any
word are copies of each other (no words); repeated rows of an id count once; very long texts are hashed whole;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import unicodedata
import zlib
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.shared import stored, table

_INVISIBLE = regex.compile(r"[\p{Cf}͏ᅟᅠ឴឵᠋-᠏ㅤ︀-️ﾠ]+")
_WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}]+(?:(?<=\p{Nd})[.,](?=\p{Nd})[\p{L}\p{M}\p{Nd}]+)*")
_ASCII_WORD = regex.compile(r"[a-z0-9]+(?:(?<=[0-9])[.,](?=[0-9])[a-z0-9]+)*")
_FIELD_END = regex.compile(r"[;|]")
_FIELD = regex.compile(r"([^:=]*[\p{L}\p{M}\p{Nd}][^:=]*)[:=](.*)", regex.S)

#: A text counts as a record of fields from this many fields on.
MIN_FIELDS = 3


def folded(text: str) -> str:
    """``text`` with full case folding, compatibility forms composed and invisible characters dropped."""
    if text.isascii():
        return text.lower()
    # folding can decompose and normalising can bring back capitals: Unicode's NFKC_Casefold is this fixed point
    text = _INVISIBLE.sub("", text)
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFD", text).casefold())
    return unicodedata.normalize("NFKC", _INVISIBLE.sub("", text).casefold())


def words(text: str) -> str:
    """The words of a folded text, divided by single spaces."""
    return " ".join((_ASCII_WORD if text.isascii() else _WORD).findall(text))


def canonical(text: str) -> tuple[str, str | None]:
    """The words in order, and for a record of fields its sorted fields."""
    flat = folded(text)
    if ";" in flat or "|" in flat:
        parts = [p for p in _FIELD_END.split(flat) if words(p)]
        fields = [_FIELD.fullmatch(p) for p in parts]
        if len(parts) >= MIN_FIELDS and all(fields):
            return words(flat), "\n".join(sorted(f"{words(m[1])}\t{words(m[2])}" for m in fields if m))
    return words(flat), None


_KEY = ["tbl", "hi", "lo", "check"]


def _halves(raw: bytes) -> tuple[int, int]:
    d = hashlib.md5(raw, usedforsecurity=False).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _check(raw: bytes) -> int:
    return zlib.crc32(raw) << 24 | len(raw) & 0xFFFFFF


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        his, los, checks, fhis, flos, fchecks = [], [], [], [], [], []
        for t in b["text"]:
            plain, by_field = canonical(t)
            raw = plain.encode("utf-8", "surrogatepass")
            hi, lo = _halves(raw)
            fhi, flo, fcheck = None, None, None
            if by_field is not None:
                fields = b"fields\n" + by_field.encode("utf-8", "surrogatepass")
                fhi, flo = _halves(fields)
                fcheck = _check(fields)
            his.append(hi)
            los.append(lo)
            checks.append(_check(raw))
            fhis.append(fhi)
            flos.append(flo)
            fchecks.append(fcheck)
        yield pd.DataFrame({"tbl": b["tbl"], "id": b["id"], "hi": his, "lo": los, "check": checks, "fhi": pd.array(fhis, dtype="Int64"), "flo": pd.array(flos, dtype="Int64"), "fcheck": pd.array(fchecks, dtype="Int64")})


def _parts(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tbl, id, hi, lo, check) of the records that may have copies, by the key of their group; and of all others, by their own.

    hi and lo are the 128-bit hash; check is an independent hash of the same canonical form (the sorted fields of a record), so that a
    collision of the first shows as two checks under one key. Counts by hash, combined before the shuffle, tell the few records
    that share a hash or consist of fields; only those are compared further. The flat layout of a record of fields (same
    words, separators lost) is led to the key of its fields.
    """
    schema = "tbl string, id string, hi long, lo long, check long, fhi long, flo long, fcheck long"
    hashed = stored(items.where("id is not null and text is not null").select("tbl", "id", "text").mapInPandas(_hashes, schema))
    counts = hashed.groupBy(*_KEY).agg(F.count("*").alias("n"), F.count("fhi").alias("n_fields"))
    shared = counts.where("n > 1 or n_fields > 0").select(*_KEY)
    some = hashed.join(shared, _KEY, "left_semi").dropDuplicates()
    records = some.where("fhi is not null").groupBy(*_KEY).agg(F.min(F.struct("fhi", "flo", "fcheck")).alias("f"))
    linked = some.join(records, _KEY, "left")
    fhi, flo, fcheck = (F.coalesce(c, f"f.{c}") for c in ("fhi", "flo", "fcheck"))
    keyed = linked.select("tbl", "id", F.coalesce(fhi, "hi").alias("hi"), F.coalesce(flo, "lo").alias("lo"), F.coalesce(fcheck, "check").alias("check"))
    alone = hashed.join(counts.where("n = 1 and n_fields = 0").select(*_KEY), _KEY, "left_semi").select("tbl", "id", "hi", "lo", "check")
    return keyed.dropDuplicates(), alone


def _grouped(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy(*_KEY).agg(F.min("id").alias("rep_id"), F.count("*").alias("n_copies"))


def copy_groups(items: DataFrame) -> DataFrame:
    """One row per distinct text of ``items(tbl, id, text)``: (tbl, hi, lo, check, rep_id, n_copies)."""
    keyed, alone = _parts(items)
    return _grouped(keyed).unionByName(alone.select(*_KEY, F.col("id").alias("rep_id"), F.lit(1).cast("long").alias("n_copies")))


def items_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    dps = table(spark, sf_dir, "data_points").select(F.lit("data_points").alias("tbl"), F.col("dp_id").alias("id"), "text")
    hyps = table(spark, sf_dir, "hypotheses").select(F.lit("hypotheses").alias("tbl"), F.col("hyp_id").alias("id"), "text")
    return dps.unionByName(hyps)


def copies(items: DataFrame) -> DataFrame:
    """(tbl, id_a, id_b): each id with the smallest id of its group, but the smallest itself."""
    keyed, _ = _parts(items)
    several = _grouped(keyed).where("n_copies > 1").drop("n_copies")
    pairs = keyed.join(several, _KEY).where("id <> rep_id")
    return pairs.select("tbl", F.col("rep_id").alias("id_a"), F.col("id").alias("id_b"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy with the smallest id of its group."""
    return copies(items_of(spark, sf_dir))


def p2_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct record with the number of its copies; ``collided`` tells a 128-bit hash shared by others."""
    groups = copy_groups(items_of(spark, sf_dir))
    shared = groups.groupBy("tbl", "hi", "lo").agg(F.min("check").alias("least"), F.max("check").alias("most")).where("least < most").select("tbl", "hi", "lo", F.lit(True).alias("hit"))
    return groups.join(shared, ["tbl", "hi", "lo"], "left").select("tbl", "rep_id", "n_copies", F.coalesce("hit", F.lit(False)).alias("collided"))


QUERIES = {"p2_found": p2_found, "p2_collapsed": p2_collapsed}
SQL: dict[str, str] = {}
