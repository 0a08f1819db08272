"""Defective answers of the oracle: empty, truncated, refusals, copies of the question, answers in another language.

The language test compares the posteriors of prompt and response under a character n-gram naive Bayes model; the
truncation test asks an n-gram model how likely a text ends after its last characters, backing off from long to short
contexts. Both are fitted on all answers, hypotheses and documents, counted where they are; of the contexts only those
that an answer without an end asks for are kept. Every row is then judged. A copy is an answer whose characters are covered by runs of the hypothesis and the data point.

Defined results for odd input: a null or blank column is ``empty``; a row with a null key part gives no case (it
cannot be named); a hypothesis or data point that is absent or null only loses the tests that need it; a text of any length
is read whole; repeated rows give one case; an empty table gives none; further columns are not read. A row with several
defects gets the first of empty, refusal, copy, truncated, language.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.format_dups import folded
from tessera.plans.shared import discard, spread, stored, table

# ------------------------------------------------------------------------------------------------ language
_BUCKETS = 1 << 15
_GRAMS = (1, 2, 3, 4)
#: Figures, codes and capitalised words; all begin with a set of characters, which the search can look for by itself.
_NAME = re.compile(r"[A-Z\d](?:(?<=\d)[\d.,:/-]*|(?<=[A-Z])[A-Z]{0,2}[-‑–/ ]?\d+|(?<=[^.!?\s] [A-Z])[\w’']+(?: [A-Z][\w’']+)*)")
_QUOTED = re.compile(r"“[^”]*”|„[^“]*“|«[^»]*»|\"[^\"]*\"")
#: Nats by which another language must beat the prompt's before an answer counts as written in it.
LANGUAGE_MARGIN = 4.0
#: A short answer that is this usual in the prompt's language, against the other, is an answer in either.
WHOLE_RATIO, WHOLE_CHARS = 0.2, 40
#: Nats by which a hypothesis' declared language is favoured a priori.
DECLARED_PRIOR = 20.0


def _plain(text: str) -> str:
    """The text without quoted words, codes, figures and capitalised words inside a sentence."""
    return " ".join(_NAME.sub(" ", _QUOTED.sub(" ", text)).lower().split())


def _gram_buckets(text: str) -> np.ndarray:
    cp = np.frombuffer(f" {text} ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    found = []
    for n in _GRAMS:
        if len(cp) >= n:
            h = np.full(len(cp) - n + 1, n * 0x9E3779B97F4A7C15 & (1 << 64) - 1, dtype=np.uint64)
            for k in range(n):
                h = (h ^ cp[k : len(cp) - n + 1 + k]) * np.uint64(0xFF51AFD7ED558CCD)
                h ^= h >> np.uint64(29)
            found.append(h & np.uint64(_BUCKETS - 1))
    return np.concatenate(found).astype(np.int64)


def _pieces(texts: list[str]) -> Iterator[list[str]]:
    """The texts by about 64,000 characters, whose arrays stay in a core's cache."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= 1 << 16 or i == len(texts) - 1:
            yield texts[a : i + 1]
            a, size = i + 1, 0


def _gram_places(plains: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per length of n-gram: the buckets of texts together, as ``_gram_buckets`` has them for each, and at which character each begins."""
    padded = [f" {p} " for p in plains]
    cp = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    ends = np.cumsum([len(p) for p in padded])
    inside = np.ones(len(cp), bool)
    for n in _GRAMS:
        if n > 1:  # runs that begin so near the end of a text would leave it
            inside[np.maximum(ends - n + 1, 0)] = False
        if len(cp) >= n:
            h = np.full(len(cp) - n + 1, n * 0x9E3779B97F4A7C15 & (1 << 64) - 1, dtype=np.uint64)
            for k in range(n):
                h = (h ^ cp[k : len(cp) - n + 1 + k]) * np.uint64(0xFF51AFD7ED558CCD)
                h ^= h >> np.uint64(29)
            at = np.flatnonzero(inside[: len(h)])
            yield (h & np.uint64(_BUCKETS - 1)).astype(np.int64)[at], at


def _gram_counts(plains: list[str]) -> np.ndarray:
    """How often each bucket occurs in texts together."""
    out = np.zeros(_BUCKETS, np.int64)
    for buckets, _ in _gram_places(plains):
        out += np.bincount(buckets, minlength=_BUCKETS)
    return out


class LanguageCounts:
    """What the language model is fitted on: n-grams and texts per language, and how often short answers occur."""

    def __init__(self) -> None:
        self.grams: dict[str, np.ndarray] = {}
        self.whole: Counter[tuple[str, str]] = Counter()
        self.rows: Counter[str] = Counter()

    def add(self, text: str, lang: str) -> None:
        self.add_all([text], lang)

    def add_all(self, texts: list[str], lang: str) -> None:
        plains = [_plain(t) for t in texts]
        self.grams.setdefault(lang, np.zeros(_BUCKETS, np.int64))
        for part in _pieces(plains):
            self.grams[lang] += _gram_counts(part)
        self.rows[lang] += len(plains)
        self.whole.update((p, lang) for p in plains if len(p) <= WHOLE_CHARS)


class LanguageModel:
    """Multinomial naive Bayes over hashed character n-grams."""

    def __init__(self, rows: list[tuple[str, str]]):
        found = LanguageCounts()
        for text, lang in rows:
            found.add(text, lang)
        self._fit(found)

    @classmethod
    def of(cls, counts: LanguageCounts) -> LanguageModel:
        model = cls.__new__(cls)
        model._fit(counts)
        return model

    def _fit(self, found: LanguageCounts) -> None:
        self.languages = sorted(found.rows)
        self.whole: dict[str, list[int]] = {}
        self.rows = [found.rows[x] for x in self.languages]
        counts = np.full((len(self.languages), _BUCKETS), 0.1, dtype=np.float64)
        for i, lang in enumerate(self.languages):
            if lang in found.grams:
                counts[i] += found.grams[lang]
        for (plain, lang), n in found.whole.items():
            self.whole.setdefault(plain, [0] * len(self.languages))[self.languages.index(lang)] += n
        self.logp = np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32) if self.languages else np.zeros((_BUCKETS, 0), np.float32)
        self._by_language = [np.ascontiguousarray(x) for x in self.logp.T]

    def common(self, plain: str, asked: int, given: int) -> bool:
        """Whether a short answer is about as usual in one language as in the other ("Plausible.")."""
        n = self.whole.get(plain)
        return n is not None and n[asked] >= 3 and n[asked] * self.rows[given] >= WHOLE_RATIO * n[given] * self.rows[asked]

    def scores(self, text: str) -> np.ndarray:
        """Log-likelihood of the text per language (n-grams overlap, so their mean weight is one gram length)."""
        return self.scores_of([_plain(text)])[0]

    def scores_of(self, plains: list[str]) -> np.ndarray:
        """The same of texts without names, a row each; zeros where nothing is left of a text."""
        out = np.zeros((len(plains), len(self.languages)))
        done = 0
        for part in _pieces(plains):
            owner = np.repeat(np.arange(len(part)), [len(p) + 2 for p in part])
            for buckets, at in _gram_places(part):
                of = owner[at]
                for i, logp in enumerate(self._by_language):
                    out[done : done + len(part), i] += np.bincount(of, logp[buckets], len(part))
            done += len(part)
        out[[not p for p in plains]] = 0
        return out / len(_GRAMS)


# ------------------------------------------------------------------------------------------------ end of text
_CONTEXTS = (24, 12, 8, 5, 3)
_END_MIN = 6
#: An unpunctuated text is cut off when an end after its last characters is less likely than this.
END_LIKELIHOOD = 0.25


class EndModel:
    """Likelihood that a text ends after a context of characters: ends seen after it / times it was seen."""

    def __init__(self, texts: list[str]):
        self.seen = [{k: v for k, v in seen.items() if v[0] >= _END_MIN} for seen in self.counts(texts)]

    @classmethod
    def of(cls, seen: list[dict[str, list[int]]]) -> EndModel:
        model = cls.__new__(cls)
        model.seen = seen
        return model

    @classmethod
    def counts(cls, texts: list[str]) -> list[dict[str, list[int]]]:
        """Per length of context: how often it was seen and how often a text ended after it."""
        out: list[dict[str, list[int]]] = []
        for n in _CONTEXTS:
            seen: dict[str, list[int]] = {}
            for t in texts:
                t = cls._form(t, n)
                for i in range(n, len(t) + 1):
                    cell = seen.setdefault(t[i - n : i], [0, 0])
                    cell[0] += 1
                    cell[1] += i == len(t)
            out.append(seen)
        return out

    @staticmethod
    def _form(text: str, n: int) -> str:
        return "\x02" * n + re.sub(r"\d", "0", text)

    def likelihood(self, text: str) -> float:
        for n, seen in zip(_CONTEXTS, self.seen, strict=True):
            cell = seen.get(self._form(text, n)[-n:])
            if cell:
                return (cell[1] + 0.1) / (cell[0] + 1)
        return 0.0


_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
#: Bits of the bitmap of contexts asked for: 2 MB.
_ASKED_BITS = 24
#: Characters up to which powers are kept.
_ROOM = 1 << 17


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(base))]), dtype=np.uint64)


@functools.cache
def _kept_powers(base: int) -> np.ndarray:
    return _powers(base, _ROOM)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ x >> np.uint64(29)


def _contexts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per length of context: 64-bit keys of the contexts before every place of the texts and after their ends, in order, and which are the latter."""
    pad = max(_CONTEXTS)
    forms = EndModel._form("".join(["\x02" * pad + t for t in texts]), 0)
    cp = np.frombuffer(forms.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size, ends = len(cp), np.cumsum([pad + len(t) for t in texts])
    powers, back = ((_kept_powers(b) if size < _ROOM else _powers(b, size))[: size + 1] for b in (_BASE, _UNBASE))
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_mixed(cp + np.uint64(1)) * powers[:-1], out=sums[1:])
    stop, is_end = np.ones(size + 1, bool), np.zeros(size + 1, bool)
    is_end[ends] = True
    for k in range(1, pad):  # contexts end after the padding of their text, or at the end of the text before it
        stop[ends[:-1] + k] = False
    stop, is_end = stop[pad:], is_end[pad:][stop[pad:]]
    for n in _CONTEXTS:
        yield _mixed(((sums[pad:] - sums[pad - n : -n]) * back[pad - n : -n])[stop] + np.uint64(n)), is_end


def _end_keys(text: str) -> list[int]:
    """The keys of a text's last contexts, from the longest."""
    return [int(keys[-1]) for keys, _ in _contexts([text[-max(_CONTEXTS) :]])]


class KeyedEnds(EndModel):
    """The same model by the keys of its contexts."""

    def __init__(self, keys: np.ndarray, seen: np.ndarray, ended: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts_of = keys[order], (seen[order], ended[order])
        self._known: dict[str, float] = {}

    def likelihood(self, text: str) -> float:
        tail = text[-max(_CONTEXTS) :]
        if tail not in self._known:
            if len(self._known) > 100_000:
                self._known.clear()
            self._known[tail] = self._of(tail)
        return self._known[tail]

    def _of(self, text: str) -> float:
        for key in _end_keys(text):
            at = int(np.searchsorted(self.keys, np.uint64(key)))
            if at < len(self.keys) and int(self.keys[at]) == key:
                return (int(self.counts_of[1][at]) + 0.1) / (int(self.counts_of[0][at]) + 1)
        return 0.0


# ------------------------------------------------------------------------------------------------ rules
CHANGE_LABELS = ("ruled_out", "much_less", "less", "unchanged", "more", "much_more", "guaranteed")
VERDICT_LABELS = ("strongly_contradicts", "contradicts", "neutral", "supports", "strongly_supports")
_HOLLOW = frozenset("null none na nan nil empty undefined missing tbd todo nothing blank".split())
_LONGEST_HOLLOW = max(map(len, _HOLLOW))
_REFUSAL = re.compile(
    r"(?i)as an? (?:ai|language model|assistant)|under my guidelines|"
    r"\b(?:can ?not|can['’]t|unable to|won['’]t|will not|(?:would )?rather not|prefer not to|decline[ds]?|refuse[ds]?|not able to|(?:have )?the ability to|do not|don['’]t|inappropriate)\b[^.!?]{0,40}\b(?:help|assess\w*|evaluat\w*|judg\w*|rat(?:e|ing)|answer\w*|respond\w*|speculat\w*|compar\w*|comment\w*|determine|say|discuss)\b|"
    r"not something i can|^\W*(?:declined|refused|no comment|cannot[_ ]say|won['’]t answer|no answer)\W*$|"
    r"\b(?:kann|darf|möchte|werde|will|muss|soll)\b[^.!?]{0,60}\b(?:nicht|keine?n?|ablehnen)\b[^.!?]{0,30}\b(?:bewerten|beurteilen|einschätz\w*|beantworten|helfen|vergleichen|urteilen|geben|sagen)\b|\bmuss ich ablehnen\b|"
    r"\b(?:ne (?:peux|puis|souhaite|veux) pas|impossible de|dois refuser|dois décliner|préfère ne pas|pas en mesure de|refuse de)\b[^.!?]{0,30}\b(?:évaluer|répondre|comparaison|comparer|juger|aider|noter|prononcer|demande)\b|"
    r"\b(?:no (?:puedo|quiero|debo)|no me es posible|debo rechazar|prefiero no|me niego a)\b[^.!?]{0,30}\b(?:valorar|responder|comparaci[oó]n|comparar|juzgar|evaluar|ayudar|opinar|solicitud)\b|"
    r"не (?:могу|буду|готов)[^.!?]{0,30}(?:оцен|ответ|суд|помочь|сравн)|вынужден отказ|无法(?:评估|回答|判断)|不能(?:评估|回答|判断)|拒绝(?:评估|回答|判断)|(?:評価|回答|判断)(?:することは)?(?:できません|できない|いたしかねます)"
)
_WRAPPED = re.compile(r"\"why\"\s*:\s*\"(.*)$", re.S)
_QUOTED_LEAD = re.compile(r"^\s*(?:“[^”]*”|„[^“]*“|«[^»]*»)\s*[—–-]\s+(?=\S)")
_CLOSERS, _TERMINATORS = "”\"»)」]’'", frozenset(".!?。！？।؟")
_CUT_MARKS = re.compile(r"(?:\.\.\.|…|[,;:—–-]|\"\s*\}|\})+\s*$")
_CUT_LAST = ("...", *"…,;:—–-}")
_OTHER = re.compile(r"[\W_]+")
_SHINGLE = 5
#: Share of an answer's runs that the question must hold, and the characters of framing words allowed besides.
COPY_SHARE = 0.62
COPY_FRAME = 34


def is_empty(text: str | None) -> bool:
    """Null, blank, or a placeholder without content."""
    if text is None:
        return True
    if sum(map(str.isalnum, text[:20])) > _LONGEST_HOLLOW:
        return False
    words = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text).split()
    return not words or "".join(words).lower() in _HOLLOW


def rationale_of(text: str) -> tuple[str, bool]:
    """The rationale proper of an answer that may still be wrapped in its JSON object, and whether that object is broken."""
    t = text.strip()
    if t.startswith("{"):
        try:
            inner = json.loads(t)
            if isinstance(inner, dict):
                return str(inner.get("why") or ""), False
        except ValueError:
            pass
        m = _WRAPPED.search(t)
        return (m.group(1) if m else ""), True
    return t, False


def _cut_label(label: str, labels: tuple[str, ...]) -> bool:
    v = label.strip().lower()
    return v not in labels and len(v) >= 2 and any(w.startswith(v) for w in labels)


class _Letters(dict[str, str]):
    """The letters of words, kept."""

    def __missing__(self, word: str) -> str:
        letters = _OTHER.sub("", folded(word))
        if len(word) <= 32:
            if len(self) >= 1 << 16:
                self.clear()
            self[word] = letters
        return letters


_LETTERS = _Letters()


def _letters(text: str) -> str:
    return "".join(map(_LETTERS.__getitem__, text.split(" ")))  # folding leaves spaces, and nothing joins across them


def is_copy(why: str, hyp: str, dp: str) -> bool:
    """Whether all of ``why`` but a few framing words are runs of the hypothesis or the data point (both as letters)."""
    s = _letters(why)
    n = len(s) - _SHINGLE + 1
    if len(s) < 20:
        return False
    known = f"{hyp} {dp}"  # no run has a space
    misses_left = min(n - COPY_SHARE * n, COPY_FRAME + 0.1 * n)
    for i in range(0, n - 1, 2):
        if s[i + 1 : i + _SHINGLE] in known:
            misses_left -= (s[i : i + _SHINGLE] not in known) + (s[i + 1 : i + 1 + _SHINGLE] not in known)
        else:  # what both runs have in common
            misses_left -= 2
        if misses_left < 0:
            return False
    return misses_left >= (n % 2 and s[n - 1 :] not in known)


def _open_end(why: str) -> str | None:
    """The text before marks of a cut where it is not finished, else none."""
    body = why.strip()
    if body.endswith(_CUT_LAST):
        body = _CUT_MARKS.sub("", body).rstrip()
    return None if body.rstrip(_CLOSERS)[-1:] in _TERMINATORS else body  # also one finished before what follows it


class Judge:
    """The tests with their fitted models; ``defects`` gives the first that each answer fails."""

    def __init__(self, languages: LanguageModel, ends: EndModel):
        self.languages, self.ends = languages, ends
        self._hyps: dict[str, tuple[str, int]] = {}
        self._answers: dict[str, tuple[bool, int, list[float]]] = {}
        self._dp = "", ""

    def _hyp(self, hyp: str, lang: str) -> tuple[str, int]:
        """The letters of a hypothesis and the likeliest language of it."""
        found = self._hyps.get(hyp)
        if found is None:
            if len(self._hyps) > 20_000:
                self._hyps.clear()
            scores = self.languages.scores(hyp) + np.array([DECLARED_PRIOR * (x == lang) for x in self.languages.languages])
            found = self._hyps[hyp] = _letters(hyp), int(scores.argmax()) if len(scores) and scores.any() else -1
        return found

    def _dp_letters(self, dp: str) -> str:
        """The letters of a data point; its answers come together."""
        if dp != self._dp[0]:
            self._dp = dp, _letters(dp)
        return self._dp[1]

    def _read(self, plains: set[str]) -> None:
        """Keep, by their words without names, which answers decline to judge, their likeliest language and their log-likelihood per language."""
        new = [p for p in plains if p not in self._answers]
        if len(self._answers) + len(new) > 100_000:
            self._answers.clear()
            new = list(plains)
        scores = self.languages.scores_of(new)
        given = np.where(scores.any(axis=1), scores.argmax(axis=1), -1) if scores.size else np.full(len(new), -1)
        self._answers.update((p, (bool(_REFUSAL.search(p)), g, x)) for p, g, x in zip(new, given.tolist(), scores.tolist(), strict=True))

    def truncated(self, why: str) -> bool:
        body = _open_end(why)
        return body is not None and (not body or self.ends.likelihood(body) < END_LIKELIHOOD)

    def defect(self, change: str | None, verdict: str | None, why: str | None, hyp: str | None, lang: str | None, dp: str | None) -> str | None:
        return self.defects([(change, verdict, why, hyp, lang, dp)])[0]

    def defects(self, rows: list[tuple[str | None, str | None, str | None, str | None, str | None, str | None]]) -> list[str | None]:
        """The defects of (change, verdict, rationale, hypothesis, its language, data point)."""
        read = [self._rationale(*row[:3]) for row in rows]
        self._read({x[3] for x in read if x})
        return [self._judged(*x, *row) if x else "empty" for x, row in zip(read, rows, strict=True)]

    @staticmethod
    def _rationale(change: str | None, verdict: str | None, why: str | None) -> tuple[str, bool, str, str] | None:
        """The rationale proper, whether its object is broken, and it without a leading quotation and without names; none for an empty answer."""
        if is_empty(why) or change not in CHANGE_LABELS and is_empty(change) or verdict not in VERDICT_LABELS and is_empty(verdict):
            return None
        assert why is not None
        inner, broken = rationale_of(why)
        if not broken and inner != why and is_empty(inner):
            return None
        own = _QUOTED_LEAD.sub("", inner)
        return inner, broken, own, _plain(own)

    def _judged(self, inner: str, broken: bool, own: str, plain: str, change: str, verdict: str, why: str, hyp: str | None, lang: str | None, dp: str | None) -> str | None:
        sound_change, sound_verdict = change in CHANGE_LABELS, verdict in VERDICT_LABELS
        declines, given, scores = self._answers[plain]
        if declines or not sound_change and _REFUSAL.search(change):
            return "refusal"
        hyp_letters, asked = self._hyp(hyp, lang or "") if hyp else ("", -1)
        if is_copy(own, hyp_letters, self._dp_letters(dp) if dp else ""):
            return "copy"
        if broken or not sound_change and _cut_label(change, CHANGE_LABELS) or not sound_verdict and _cut_label(verdict, VERDICT_LABELS) or self.truncated(inner):
            return "truncated"
        if asked >= 0 and given >= 0 and given != asked and scores[given] - scores[asked] >= LANGUAGE_MARGIN and not self.languages.common(plain, asked, given):
            return "language"
        return None


# ------------------------------------------------------------------------------------------------ plan
def _language_label(col: str) -> F.Column:
    return F.substring(F.lower(F.trim(col)), 1, 2)


_FIT_COLUMNS = "kind string, lang string, key string, at long, a long"
#: Short answers that a task holds before it sends them on, and characters whose contexts it counts at once.
_HELD, _AT_ONCE = 200_000, 1 << 21


def _fit_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of (text, lang, answer): n-grams ``g``, short answers ``w``, texts ``r`` by language, and the contexts ``q`` that answers without an end ask for."""
    found, tails = LanguageCounts(), set[str]()

    def sent() -> Iterator[pd.DataFrame]:
        asked = np.unique(np.concatenate([key[is_end] for key, is_end in _contexts(list(tails))])) if tails else []
        if found.whole:
            yield pd.DataFrame({"kind": "w", "lang": [x for _, x in found.whole], "key": [p for p, _ in found.whole], "at": 0, "a": list(found.whole.values())})
        if len(asked):
            yield pd.DataFrame({"kind": "q", "lang": "", "key": "", "at": asked.view(np.int64), "a": 1})
        found.whole.clear()
        tails.clear()

    for b in batches:
        by_lang: dict[str, list[str]] = {}
        for t, lang, answer in zip(b["text"], b["lang"], b["answer"], strict=True):
            if answer:
                t = rationale_of(t)[0] or ""
                if body := _open_end(t):
                    tails.add(body[-max(_CONTEXTS) :])
            if lang is not None and len(lang) == 2:
                by_lang.setdefault(lang, []).append(t)
        for lang, texts in by_lang.items():
            found.add_all(texts, lang)
        if len(found.whole) + len(tails) > _HELD:
            yield from sent()
    yield from sent()
    if found.rows:
        yield pd.DataFrame({"kind": "r", "lang": list(found.rows), "key": "", "at": 0, "a": list(found.rows.values())})
    for lang, grams in found.grams.items():
        at = np.flatnonzero(grams)
        if len(at):
            yield pd.DataFrame({"kind": "g", "lang": lang, "key": "", "at": at, "a": grams[at]})


def _asked_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bits = np.zeros(1 << _ASKED_BITS, bool)
    for b in batches:
        bits[b["at"].to_numpy().view(np.uint64) >> np.uint64(64 - _ASKED_BITS)] = True
    yield pd.DataFrame({"bits": [np.packbits(bits).tobytes()]})


def _context_counts(asked) -> object:  # noqa: ANN001 - a broadcast variable
    """How often contexts of answers whose bit is set were seen, and how often an answer ended after them."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(asked.value).astype(bool)

        def of(texts: list[str]) -> pd.DataFrame:
            keys, stops = [], []
            for part in _pieces(texts):
                for key, is_end in _contexts(part):
                    own = bits[key >> np.uint64(64 - _ASKED_BITS)]
                    keys.append(key[own])
                    stops.append(is_end[own])
            at, key = pd.factorize(np.concatenate(keys))
            return pd.DataFrame({"at": key.view(np.int64), "a": np.bincount(at, minlength=len(key)), "b": np.bincount(at, np.concatenate(stops), len(key)).astype(np.int64)})

        held: list[str] = []
        size = 0
        for b in batches:
            for t in b["text"]:
                t = rationale_of(t)[0]
                if t:
                    held.append(t)
                    size += len(t)
                if size >= _AT_ONCE:
                    yield of(held)
                    held, size = [], 0
        if held:
            yield of(held)

    return counts


def fit(lift: DataFrame, hyps: DataFrame, documents: DataFrame) -> Judge:
    """The models, from all answers, hypotheses and documents labelled by language.

    The counts are made where the rows are. To the driver come n-grams by language, short answers that occur three times, and contexts
    seen ``_END_MIN`` times that an answer without an end asks for.
    """
    spark = lift.sparkSession
    asked = hyps.select("hyp_id", F.col("text").alias("hyp"), F.coalesce(_language_label("lang"), F.lit("")).alias("lang"))
    told = lift.where("rationale is not null").join(asked.select("hyp_id", "lang"), "hyp_id", "left").select(F.col("rationale").alias("text"), "lang", F.lit(True).alias("answer"))
    claims = asked.where("hyp is not null").select(F.col("hyp").alias("text"), "lang", F.lit(False).alias("answer"))
    docs = documents.where("text is not null").select("text", _language_label("lang").alias("lang"), F.lit(False).alias("answer"))
    counts = spread(told.unionByName(claims).unionByName(docs)).mapInPandas(_fit_counts, _FIT_COLUMNS)
    sums = stored(counts.groupBy("kind", "lang", "key", "at").agg(F.sum("a").alias("a")))
    # a short answer counts in either language where it occurs three times in one
    usual = sums.where("kind = 'w'").groupBy("key").agg(F.max("a").alias("most")).where("most >= 3").select("key")
    short = sums.where("kind = 'w'").join(usual, "key", "left_semi").select("kind", "lang", "key", "at", "a")
    wanted = sums.where("kind = 'q'").select("at")
    bits = wanted.coalesce(1).mapInPandas(_asked_bits, "bits binary").first()
    bitmap = spark.sparkContext.broadcast(np.frombuffer(bits.bits, np.uint8) if bits else np.zeros((1 << _ASKED_BITS) // 8, np.uint8))
    contexts = spread(lift.where("rationale is not null").select(F.col("rationale").alias("text"))).mapInPandas(_context_counts(bitmap), "at long, a long, b long")
    ends = stored(contexts.groupBy("at").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(f"a >= {_END_MIN}").join(wanted, "at", "left_semi"))
    languages = LanguageCounts()
    small = sums.where("kind in ('r', 'g')").select("kind", "lang", "key", "at", "a").unionByName(short).toPandas()
    for kind, lang, key, _, a in small[small["kind"] != "g"].itertuples(index=False):
        if kind == "r":
            languages.rows[lang] = a
        else:
            languages.whole[key, lang] = a
    for lang, own in small[small["kind"] == "g"].groupby("lang"):
        languages.grams[lang] = np.bincount(own["at"], own["a"], _BUCKETS).astype(np.int64)
    seen = ends.toPandas()
    discard(sums)
    discard(ends)
    return Judge(LanguageModel.of(languages), KeyedEnds(seen["at"].to_numpy(np.int64).view(np.uint64), seen["a"].to_numpy(np.int64), seen["b"].to_numpy(np.int64)))


def defects(lift: DataFrame, hyps: DataFrame, data_points: DataFrame, documents: DataFrame) -> DataFrame:
    """(hyp_id, dp_id, model, defect) of every defective answer."""
    spark = lift.sparkSession
    hyp_rows = hyps.where("hyp_id is not null").groupBy("hyp_id").agg(F.min("text").alias("text"), F.min(F.get_json_object("meta", "$.lang")).alias("lang"))
    lift = lift.where("hyp_id is not null and dp_id is not null and model is not null").select("hyp_id", "dp_id", "model", "change", "verdict", "rationale")
    judge = spark.sparkContext.broadcast(fit(lift, hyp_rows, documents))
    dp_rows = data_points.where("dp_id is not null").groupBy("dp_id").agg(F.min("text").alias("dp"))
    joined = lift.join(hyp_rows.select("hyp_id", F.col("text").alias("hyp"), _language_label("lang").alias("lang")), "hyp_id", "left").join(dp_rows, "dp_id", "left")

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        j = judge.value
        for b in batches:
            found = j.defects(list(zip(*(b[c].where(b[c].notna(), None) for c in ("change", "verdict", "rationale", "hyp", "lang", "dp")), strict=True)))
            b = b[["hyp_id", "dp_id", "model"]].assign(defect=found)
            yield b[b["defect"].notna()]

    cases = joined.select("hyp_id", "dp_id", "model", "change", "verdict", "rationale", "hyp", "lang", "dp").mapInPandas(judged, "hyp_id string, dp_id string, model string, defect string")
    order = F.expr("array_position(array('empty', 'refusal', 'copy', 'truncated', 'language'), defect)")
    return cases.groupBy("hyp_id", "dp_id", "model").agg(F.min_by("defect", order).alias("defect"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defective answer with its kind of defect."""
    return defects(*(table(spark, sf_dir, t) for t in ("lift_cache", "hypotheses", "data_points", "documents")))


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective answers per model and kind."""
    return p7_found(spark, sf_dir).groupBy("model", "defect").agg(F.count("*").alias("n"))


QUERIES = {"p7_found": p7_found, "p7_rates": p7_rates}
SQL: dict[str, str] = {}
