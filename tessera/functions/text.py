"""Column functions over text: sentences, atoms, token sets, entities, cues and content ids. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scale import SPACE, clamp, col_of
from tessera.plans import settings as S


def stripped(text: Column | str) -> Column:
    return F.regexp_replace(col_of(text), rf"^{SPACE}+|{SPACE}+$", "")


def content_id(text: Column | str) -> Column:
    """Sixteen hex digits of the SHA-256 of the text's UTF-8 bytes and a zero byte."""
    return F.left(F.sha2(F.concat(F.encode(col_of(text), "UTF-8"), F.unhex(F.lit("00"))), 256), F.lit(16))


def set_key(ids: Column | str) -> Column:
    """The order-independent name of a set of ids."""
    return F.array_join(F.array_sort(F.array_distinct(col_of(ids))), ",")


def squeezed(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(col_of(text), rf"{SPACE}+", " "))


def simple_sentences(text: Column | str) -> Column:
    """Pieces between a closing mark, white space and a capital or digit; blank pieces dropped."""
    parts = F.split(squeezed(text), S.SENTENCE_END)
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def oracle_atoms(passage: Column | str, min_chars: int = S.DEFAULTS.oracle_atom_chars) -> Column:
    """Pieces after a closing mark that are longer than ``min_chars``; else the head of the passage."""
    p = stripped(passage)
    parts = F.filter(F.split(p, rf"(?<=[.!?]){SPACE}+"), lambda s: F.length(s) > min_chars)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.substring(p, 1, 200)))


def kept_atoms(atoms: Column | str, min_chars: int = S.DEFAULTS.atom_min_chars) -> Column:
    """Trimmed atoms of at least ``min_chars``, each once, in order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(col_of(atoms), stripped), lambda s: F.length(s) >= min_chars))


def _tokens(text: Column, pattern: str, stop: tuple[str, ...]) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    return F.array_except(F.filter(F.array_distinct(found), lambda t: F.length(t) > 2), F.array(*[F.lit(w) for w in stop]))


def oracle_tokens(text: Column | str) -> Column:
    return _tokens(col_of(text), S.ORACLE_WORD, S.ORACLE_STOP)


def screen_tokens(text: Column | str) -> Column:
    return _tokens(col_of(text), S.SCREEN_WORD, S.SCREEN_STOP)


def entities(text: Column | str, meta: Column | str | None = None, keys: tuple[str, ...] = S.DEFAULTS.entity_keys) -> Column:
    """Capitalised words, dates and figures, and the values of some ``meta`` keys, in lower case."""
    t = col_of(text)
    words = F.regexp_extract_all(t, F.lit(S.NAME), F.lit(0))
    figures = F.regexp_extract_all(t, F.lit(S.FIGURE), F.lit(0))
    found = F.concat(words, figures)
    if meta is not None:
        values = F.array(*[F.get_json_object(col_of(meta), f"$.{k}") for k in keys])
        found = F.concat(found, F.filter(values, lambda v: v.isNotNull() & (v != "")))
    return F.array_distinct(F.transform(found, lambda x: F.lower(x)))


def has_any(text: Column | str, cues: tuple[str, ...]) -> Column:
    low = F.lower(col_of(text))
    out = F.lit(False)
    for cue in cues:
        out = out | F.contains(low, F.lit(cue))
    return out


def negative(text: Column | str) -> Column:
    return has_any(text, S.NEGATIVE_CUES)


def lexical_prior(text: Column | str) -> Column:
    """The base rate that the lexical oracle gives a statement."""
    raw = F.when(has_any(text, S.RARE_CUES), 0.08).when(F.size(oracle_tokens(text)) > 25, 0.3).otherwise(S.DEFAULT_PRIOR)
    return clamp(raw, S.PRIOR_RANGE)


def jaccard(a: Column | str, b: Column | str) -> Column:
    x, y = col_of(a), col_of(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def lexical_relatedness(overlap: Column | str) -> Column:
    return F.round(F.least(F.lit(1.0), col_of(overlap) * 2.2), 3)


def lexical_change(overlap: Column | str, neg: Column | str) -> Column:
    """The lexical oracle's label; the order of the rungs matters."""
    o, n = col_of(overlap), col_of(neg)
    return F.when(o < 0.06, "unchanged").when(n & (o > 0.12), "much_less").when(n, "less").when(o > 0.28, "much_more").when(o > 0.12, "more").otherwise("unchanged")


def joint_change(n_neg: Column | str, n_pos: Column | str) -> Column:
    """The lexical oracle's label of statements taken together: tension, doubt, agreement or nothing."""
    neg, pos = col_of(n_neg), col_of(n_pos)
    return F.when((neg > 0) & (pos > 0), "much_less").when(neg > 0, "less").when(pos >= 2, "more").otherwise("unchanged")


def oracle_json(raw: Column | str) -> Column:
    """The JSON object in an oracle's reply (fences stripped, else the widest braces), or null."""
    t = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(col_of(raw)), r"^```(?:json)?", "")), r"```$", ""))
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    whole = F.when(F.get_json_object(t, "$").isNotNull() & t.startswith("{"), t)
    return F.coalesce(whole, F.when((inner != "") & F.get_json_object(inner, "$").isNotNull(), inner))


def labelled_field(text: Column | str, label: str) -> Column:
    """What follows the first occurrence of a label, to the end of that line (the next one, where nothing follows on its own); empty without one."""
    quoted = r"\Q" + label + r"\E"
    return stripped(F.regexp_extract(col_of(text), rf"{quoted}\s*(.+)", 1))


def prompt_kind(prompt: Column | str) -> Column:
    """Which question a free prompt asks, by the phrases that mark it, the first in this order; typed calls of an oracle do not need it."""
    kinds = []
    for among, phrases in ((col_of(prompt), S.PROMPT_PHRASES), (F.lower(col_of(prompt)), S.ANY_CASE_PHRASES)):
        for kind, groups in phrases:
            has = F.lit(False)
            for group in groups:
                every = F.lit(True)
                for phrase in group:
                    every = every & F.contains(among, F.lit(phrase))
                has = has | every
            kinds.append(F.when(has, kind))
    return F.coalesce(*kinds, F.lit("unknown"))


def source_of(meta: Column | str, doc_id: Column | str) -> Column:
    """The source named in ``meta``, else the document; an empty name falls through."""
    named = F.get_json_object(col_of(meta), "$.source")
    return F.coalesce(F.nullif(named, F.lit("")), col_of(doc_id).cast("string"))
