"""Abusive, hateful and sexual language: sentence scores combined by noisy-or, trained from document labels.

A document is a bag of sentences; a category occurs in it when it occurs in at least one of them. Sentences are
scored by a logistic model over words and word pairs (after undoing spellings that hide a word), a document by the
noisy-or of its sentences (of what they have beyond a sentence without evidence). Only documents carry labels, so the likelihood of the labels is maximised through the
noisy-or, with annotators' votes as soft targets and a small prior on well-known words that carries the model where few
labels exist. The fitted weights are a bounded dictionary; every sentence of every document is then scored, and
the best-scoring sentence locates the offence.

Defined results for odd input: a null, empty or blank text scores 0 in every category; a null id is no document;
a text of any length is read whole; repeated rows of an id count once (highest scores); with an empty label table the
prior alone scores; unknown labels and ``unsure`` carry no vote; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.format_dups import folded
from tessera.llm.sentences import units
from tessera.plans.shared import spread, table

CATEGORIES = ("abusive", "hateful", "sexual")
#: Bound of the labelled documents that the model is fitted on, drawn by hash over all that have labels.
FIT_DOCS = 6_000
#: Bound of the unlabelled documents that join the fit as weak negatives (they tell names and idiom from offence).
FIT_UNLABELLED, UNLABELLED_WEIGHT = 3_000, 0.05
#: A category occurs in a document when the noisy-or of its sentences is at least this; a sentence counts for its likeliest category, and for
#: others that it has with SURE anyhow.
OCCURS, SURE = 0.4, 0.5
_ROUNDS, _RATE, _RIDGE, _BIAS = 150, 0.2, 0.3, -4.0

#: Words that mark a category by themselves, as public word lists have them (stems; doubled letters once).
_PRIOR = {
    "abusive": "idiot moron imbecil asshole bastard scumbag dumbass wanker prick bitch cunt loser liar rat parasite clown worthless pathetic shut filthy choke rot arschloch wichser hurensohn vollidiot schwachkopf drecksau miststück lügner halt salaud connard crétin ordure menteur minable gueule cabrón gilipollas puta mierda inútil mentiroso cállate сволочь мразь идиот урод тварь дебил заткнись подонок".split(),
    "hateful": "vermin subhuman scum disease breed wiped deported inferior ungeziefer untermenschen abschaum gesindel vermine racaille parasites sous-hommes alimañas escoria chusma ratas паразиты нелюди отбросы недочеловеки".split(),
    "sexual": "blowjob cock tits naked thighs horny masturbating fuck fucked cum pussy dildo wet nude schwanz titten gefickt ficken geil nackt nacktbilder muschi bite seins baiser baisé sucer lécher cuisses nue tetas polla follar follaron chupar caliente desnuda mamada сиськи трахать трахался голые раздетой член груди".split(),
}
_PRIOR_WEIGHT = 2.5

_LEET = str.maketrans("013457@$", "oieastas")
_LEET_RUN = re.compile(r"(?<=[^\W\d_])[0-9@$]+(?=[^\W\d_])|(?<![\w.,:/-])[013457@$](?=[^\W\d_]{3})")
_SPELLED = re.compile(r"(?<!\w)(?:[^\W\d_][-._·]){2,}[^\W\d_](?!\w)")
_SPELL_MARK = re.compile(r"[-._·]")
_DOUBLED = re.compile(r"([^\W\d_])\1+")
_WORD = re.compile(r"[^\W\d_]+(?:\*+[^\W\d_]+)*")


_read: dict[str, tuple[str, ...]] = {}


def _words_of(token: str) -> tuple[str, ...]:
    """The words of a token between spaces, with hidden spellings undone."""
    found = _read.get(token)
    if found is None:
        if len(_read) > 300_000:
            _read.clear()
        t = folded(token)
        if not t.isalpha():
            t = _SPELLED.sub(lambda m: _SPELL_MARK.sub("", m.group()), t)
            t = _LEET_RUN.sub(lambda m: m.group().translate(_LEET), t)
        found = _read[token] = tuple(_WORD.findall(_DOUBLED.sub(r"\1", t)))
    return found


def words(sentence: str) -> list[str]:
    """The words of a sentence, with hidden spellings undone: spelled-out, stretched and leet letters, full-width forms."""
    found: list[str] = []
    get = _read.get
    for token in sentence.split():
        found += get(token) or _words_of(token)
    return found


def features(sentence: str) -> list[str]:
    """Words, pairs of neighbours, and a mark for a starred word."""
    w = words(sentence)
    pairs = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    return w + pairs + ["*"] * any("*" in x for x in w)


class Model:
    """Weights per feature and category; starred words are read as the weightiest word they can stand for."""

    def __init__(self, weights: dict[str, np.ndarray], bias: np.ndarray):
        self.bias = bias
        self.weights = {k: tuple(map(float, v)) for k, v in weights.items()}
        self.starred: dict[tuple[str, str], list[tuple[int, str]]] = defaultdict(list)
        for k, v in weights.items():
            if " " not in k and len(k) > 2 and v.max() > 1.0:
                self.starred[k[0], k[-1]].append((len(k), k))
        self._pairs: dict[str, dict[str, tuple[float, ...]]] = defaultdict(dict)
        for k, v in self.weights.items():
            first, _, second = k.partition(" ")
            if second:
                self._pairs[first][second] = v
        self._pairs = dict(self._pairs)

    def _unstar(self, word: str) -> str:
        near = [k for n, k in self.starred.get((word[0], word[-1]), []) if 0 <= len(word) - n <= 2 or n == len(word) + 1]
        return max(near, key=lambda k: max(self.weights[k]), default=word)

    def logits(self, sentence: str) -> tuple[float, float, float]:
        w = words(sentence)
        a, h, s = map(float, self.bias)
        get, pairs = self.weights.get, self._pairs
        seen = set()
        starred = False
        after: dict[str, tuple[float, ...]] | None = None  # the pairs that the word before begins
        before = ""
        for x in w:
            if "*" in x:
                starred, x = True, self._unstar(x)
            v = get(x)
            if v is not None and x not in seen:
                seen.add(x)
                a += v[0]
                h += v[1]
                s += v[2]
            if after is not None and (v := after.get(x)) is not None and (before, x) not in seen:
                seen.add((before, x))
                a += v[0]
                h += v[1]
                s += v[2]
            after, before = pairs.get(x), x
        if starred and (v := get("*")) is not None:
            a, h, s = a + v[0], h + v[1], s + v[2]
        return a, h, s


def _prior() -> dict[str, np.ndarray]:
    found: dict[str, np.ndarray] = {"*": np.array([1.0, 1.0, 1.0])}
    for i, c in enumerate(CATEGORIES):
        for word in _PRIOR[c]:
            for x in words(word):
                found.setdefault(x, np.zeros(3))[i] = _PRIOR_WEIGHT
    return found


def fit(labelled: list[tuple[str, dict[str, int]]]) -> Model:
    """The model of the greatest penalised likelihood of (text, votes per label)."""
    prior = _prior()
    bags = [[sorted(set(features(t[s:e]))) for s, e in units(t)] or [[]] for t, _ in labelled]
    seen = Counter(f for bag in bags for f in {f for sent in bag for f in sent})
    names = sorted(set(prior) | {f for f, n in seen.items() if n >= 2 + (" " in f)})
    at = {f: i for i, f in enumerate(names)}
    mean = np.zeros((len(names), 3))
    for f, v in prior.items():
        mean[at[f]] = v
    w, bias = mean.copy(), np.full(3, _BIAS)
    if bags:
        sentences = [[at[f] for f in sent if f in at] for bag in bags for sent in bag]
        doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        row = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
        col = np.array([i for s in sentences for i in s], dtype=np.int64)
        votes = np.array([[v.get(c, 0) for c in CATEGORIES] + [v.get("clean", 0)] for _, v in labelled], dtype=float)
        total = np.maximum(votes.sum(axis=1, keepdims=True), 1)
        target = np.clip(votes[:, :3] / total, 0.02, 0.98)
        told = votes.sum(axis=1, keepdims=True) > 0
        # a vote for one category says little about the others, as an annotator gives one label
        other = (votes[:, :3].sum(axis=1, keepdims=True) - votes[:, :3]) > 0
        weight = np.where(told, np.where(other & (votes[:, :3] == 0), 0.3, 1.0), UNLABELLED_WEIGHT)
        size = max(1.0, float(told.sum()))
        m1, m2 = np.zeros_like(w), np.zeros_like(w)
        b1, b2 = np.zeros(3), np.zeros(3)
        for step in range(1, _ROUNDS + 1):
            gw, gb = np.empty_like(w), np.empty(3)
            for c in range(3):
                z = np.bincount(row, weights=w[col, c], minlength=len(sentences)) + bias[c]
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                none = np.exp(np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(bags)))
                some = np.clip(1 - none, 1e-9, 1 - 1e-9)
                gz = ((some - target[:, c]) / some * weight[:, c])[doc] * p
                gw[:, c] = np.bincount(col, weights=gz[row], minlength=len(names)) / size
                gb[c] = gz.sum() / size
            gw += _RIDGE / size * (w - mean)
            gb += _RIDGE / size * (bias - _BIAS)
            for x, g, u, v in ((w, gw, m1, m2), (bias, gb, b1, b2)):
                u += 0.1 * (g - u)
                v += 0.01 * (g * g - v)
                x -= _RATE * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model({f: w[i] for f, i in at.items() if np.abs(w[i]).max() > 0.02}, bias)


def training_rows(documents: DataFrame, labels: DataFrame) -> list[tuple[str, dict[str, int]]]:
    """Texts and votes of about ``FIT_DOCS`` labelled documents at most, and texts without votes of others."""
    votes = labels.where("doc_id is not null").select("doc_id", F.lower(F.trim("label")).alias("label")).where(F.col("label").isin(*CATEGORIES, "clean"))
    votes = votes.groupBy("doc_id").agg(*[F.count_if(F.col("label") == c).alias(c) for c in (*CATEGORIES, "clean")])
    n = votes.count()
    drawn = votes.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, FIT_DOCS / max(1, n)) * (1 << 20)) + 1).limit(2 * FIT_DOCS)
    texts = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    rows = [(r.doc_id, r.text, {c: r[c] for c in (*CATEGORIES, "clean")}) for r in texts.join(drawn, "doc_id").toLocalIterator()]
    known = {r[0] for r in rows}
    share = min(1.0, FIT_UNLABELLED / max(1, documents.count()))
    others = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * FIT_UNLABELLED)
    rows += [(r.doc_id, r.text, {}) for r in others.toLocalIterator() if r.doc_id not in known]
    return [(t, v) for _, t, v in sorted(rows, key=lambda r: r[:2])]


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, category, score, top_sentence_score, occurs, char_start, char_end) per document and category.

    ``score`` is the noisy-or over sentences; the offsets are those of the likeliest sentence (null without any).
    """
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(fit(training_rows(documents, labels)))
    schema = "doc_id long, source string, category string, score double, top_sentence_score double, occurs boolean, char_start int, char_end int"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for b in batches:
            out: dict[str, list] = {"doc_id": [], "source": [], "category": [], "score": [], "top_sentence_score": [], "occurs": [], "char_start": [], "char_end": []}
            for doc_id, text, source in zip(b["doc_id"], b["text"], b["source"], strict=True):
                spans = units(text) if isinstance(text, str) else []
                z = np.array([m.logits(text[s:e]) for s, e in spans]).reshape(-1, 3)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                # what a sentence has beyond one without evidence: else long texts would score by their length
                none = np.minimum(0, np.log1p(-np.minimum(p, 1 - 1e-12)) + np.logaddexp(0, m.bias))
                some = -np.expm1(none.sum(axis=0))
                counts = (p == p.max(axis=1, keepdims=True)) | (p >= SURE) if len(spans) else p > 1
                hit = -np.expm1((none * counts).sum(axis=0)) >= OCCURS
                for i, c in enumerate(CATEGORIES):
                    k = int(p[:, i].argmax()) if len(spans) else -1
                    for name, v in (("doc_id", doc_id), ("source", source), ("category", c), ("score", float(some[i]) if k >= 0 else 0.0), ("top_sentence_score", float(p[k, i]) if k >= 0 else 0.0), ("occurs", bool(hit[i])), ("char_start", spans[k][0] if k >= 0 else None), ("char_end", spans[k][1] if k >= 0 else None)):
                        out[name].append(v)
            yield pd.DataFrame(out).astype({"char_start": "Int32", "char_end": "Int32"})

    source = F.regexp_replace(F.lower(F.trim("source")), r"[\s-]+", "_").alias("source")
    return spread(documents.where("doc_id is not null").select("doc_id", "text", source)).mapInPandas(rows, schema)


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and category that occurs in a sentence of it."""
    return scored(*_inputs(spark, sf_dir)).where("occurs").select("doc_id", "category").dropDuplicates()


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document in every category, and where its likeliest sentence stands."""
    best = F.max_by(F.struct("top_sentence_score", "char_start", "char_end"), "score").alias("b")
    return scored(*_inputs(spark, sf_dir)).groupBy("doc_id", "category").agg(F.max("score").alias("score"), best).select("doc_id", "category", "score", "b.top_sentence_score", "b.char_start", "b.char_end")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, occurrences and rate per source and category."""
    hit = F.count_if("occurs")
    once = scored(*_inputs(spark, sf_dir)).groupBy("doc_id", "source", "category").agg(F.max("occurs").alias("occurs"))
    return once.groupBy("source", "category").agg(F.count("*").alias("n_docs"), hit.alias("n_found"), (hit / F.count("*")).alias("rate"))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}
SQL: dict[str, str] = {}
