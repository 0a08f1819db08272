"""Oversized texts cut into pieces under a limit, at natural boundaries, with an exact overlap.

Cuts are defined by content: in the window in which the next cut may lie, a rolling hash marks a landmark (the
position of the least hash), and the cut snaps to the natural boundary nearest to it: the end of a paragraph or
sentence, else of a line, else a space, else the landmark itself. As landmarks depend on nearby characters only,
an edit moves the cuts next to it and the later ones fall where they fell before.

Defined results for odd input: null ids and null texts give no pieces; texts within the limit are not listed; a
table without a limit, or with a null one, is not cut; of several limits the least holds, and of several overlaps; an overlap that
leaves no room is lowered to half the limit; a null ``ord`` counts as 0; repeated rows give their pieces once; further columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.sentences import units
from tessera.plans.shared import table

#: The least part of the room of a piece that it fills, but for the last.
LEAST_FILL = 0.4
_WINDOW = 16
_JOINERS = frozenset("‍‌")


def _landmark_hashes(text: str) -> np.ndarray:
    """A 32-bit hash of the characters before each position."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h = np.zeros(len(cp) + 1, np.uint32)
    for k in range(min(_WINDOW, len(cp))):
        h[k + 1 :] += (cp[: len(cp) - k] ^ np.uint32(0x9E37 * (k + 1))) * np.uint32(2 * k * 0x85EBCA6B + 0xC2B2AE35 & 0xFFFFFFFF)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h ^ h >> np.uint32(12)


def boundaries(text: str) -> list[np.ndarray]:
    """Positions at which a text may be cut, by rank: ends of sentences and paragraphs, of lines, of words."""
    sentences = np.array([e for _, e in units(text)], dtype=np.int64)
    lines = np.array([i + 1 for i, c in enumerate(text) if c == "\n"], dtype=np.int64)
    words = np.array([i + 1 for i, c in enumerate(text) if c.isspace()], dtype=np.int64)
    return [sentences, lines, words]


def cuts(text: str, max_chars: int, overlap_chars: int) -> list[tuple[int, int]]:
    """Pieces (start, end) of at most ``max_chars`` that cover the text, each beginning ``overlap_chars`` before the last one's end."""
    n = len(text)
    if n <= max_chars:
        return [(0, n)]
    overlap = max(0, min(overlap_chars, max_chars // 2))
    room = max_chars - overlap
    least = max(1, int(room * LEAST_FILL))
    ranks = boundaries(text)
    hashes = _landmark_hashes(text)
    pieces, start = [], 0  # a cut at ``start``: the next piece begins ``overlap`` before it
    while True:
        first = start - overlap if start else 0
        if n - first <= max_chars:
            pieces.append((first, n))
            return pieces
        # the piece after the first begins ``overlap`` before this cut, and after the text's start
        lo, hi = max(start + least, overlap + 1), min(first + max_chars, n - 1)
        mark = lo + int(hashes[lo : hi + 1].argmin())
        for at in ranks:
            a, b = np.searchsorted(at, lo), np.searchsorted(at, hi, side="right")
            if a < b:
                inside = at[a:b]
                cut = int(inside[np.abs(inside - mark).argmin()])
                break
        else:
            cut = mark
            while cut > lo and (text[cut] in _JOINERS or text[cut - 1] in _JOINERS or _combines(text[cut])):
                cut -= 1
        pieces.append((first, cut))
        start = cut


def _combines(c: str) -> bool:
    import unicodedata

    return unicodedata.category(c)[0] == "M"


def pieces(items: DataFrame, limits: DataFrame) -> DataFrame:
    """(tbl, item_id, ord, piece_no, piece_ord, char_start, char_end, text) of each item over its table's limit.

    ``piece_ord`` numbers the pieces of a chunk on from its ``ord``.
    """
    caps = limits.where("tbl is not null").groupBy("tbl").agg(F.min("max_chars").alias("max_chars"), F.min(F.coalesce("overlap_chars", F.lit(0))).alias("overlap_chars"))
    over = items.where("item_id is not null and text is not null").join(caps, "tbl").where(F.length("text") > F.col("max_chars"))
    schema = "tbl string, item_id string, ord int, piece_no int, piece_ord int, char_start int, char_end int, text string"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                base = 0 if pd.isna(r.ord) else int(r.ord)
                for k, (s, e) in enumerate(cuts(r.text, max(1, int(r.max_chars)), int(r.overlap_chars))):
                    out.append((r.tbl, r.item_id, None if pd.isna(r.ord) else int(r.ord), k, base + k, s, e, r.text[s:e]))
            yield pd.DataFrame(out, columns=["tbl", "item_id", "ord", "piece_no", "piece_ord", "char_start", "char_end", "text"]).astype({"ord": "Int32"})

    # few items are too long, and they lie anywhere: their texts are cut where they were read
    return over.select("tbl", "item_id", "ord", "text", "max_chars", "overlap_chars").mapInPandas(rows, schema).dropDuplicates()


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").cast("string").alias("item_id"), F.lit(None).cast("int").alias("ord"), "text")
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("item_id"), F.col("ord").cast("int").alias("ord"), "text")
    return docs.unionByName(chunks)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and chunks that had to be cut."""
    return p4_pieces(spark, sf_dir).select("tbl", "item_id").dropDuplicates()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document and chunk over its limit."""
    return pieces(_items(spark, sf_dir), table(spark, sf_dir, "size_limits"))


def p4_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of the pieces of every item cut: they run from its start to its end, none is over the limit, each overlaps the one before as asked, and their texts are the item's."""
    items, limits = _items(spark, sf_dir), table(spark, sf_dir, "size_limits")
    caps = limits.groupBy("tbl").agg(F.min("max_chars").alias("cap"), F.min(F.coalesce("overlap_chars", F.lit(0))).alias("asked"))
    by_no = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "char_start", "char_end"))), lambda x: x[c])
    size = F.col("char_end") - F.col("char_start")
    found = pieces(items, limits).join(F.broadcast(caps), "tbl")
    rows = found.groupBy("tbl", "item_id", "cap", "asked").agg(by_no("char_start").alias("s"), by_no("char_end").alias("e"), F.max(size).alias("most"), F.min(size).alias("least"), F.bool_and(F.length("text") == size).alias("texts"))
    at = F.sequence(F.lit(1), F.size("s") - 1)
    real = F.greatest(F.lit(0), F.least(F.col("asked"), F.floor(F.col("cap") / 2)))
    overlaps = F.forall(at, lambda i: F.get("e", i - 1) - F.get("s", i) == real)
    return rows.select("tbl", "item_id", F.get("s", F.lit(0)).alias("first_char"), F.get("e", F.size("e") - 1).alias("end_char"), ((F.col("most") <= F.col("cap")) & (F.col("least") > 0)).alias("within_limit"), overlaps.alias("overlaps_held"), "texts")


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces, "p4_cover": p4_cover}
SQL = {
    "p4_found": """select distinct i.tbl, i.item_id
                   from (select 'documents' tbl, cast(doc_id as varchar) item_id, text from documents
                         union all select 'chunks', chunk_id, text from chunks) i
                   join (select tbl, min(max_chars) max_chars from size_limits group by 1) l using (tbl)
                   where length(i.text) > l.max_chars and i.item_id is not null""",
    "p4_cover": """select distinct i.tbl, i.item_id, 0 first_char, length(i.text) end_char, true within_limit, true overlaps_held, true texts
                   from (select 'documents' tbl, cast(doc_id as varchar) item_id, text from documents
                         union all select 'chunks', chunk_id, text from chunks) i
                   join (select tbl, min(max_chars) max_chars from size_limits group by 1) l using (tbl)
                   where length(i.text) > l.max_chars and i.item_id is not null""",
}
