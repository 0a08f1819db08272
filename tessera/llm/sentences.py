"""Sentence units with offsets, for texts of any language and script.

Spaced scripts go through a lattice of terminators: every run of closing marks is a node, quotations and brackets
are arcs over the nodes inside them, and each node left is kept or passed by what stands before it (abbreviation,
initial, figure, ordinal, file name) and after it (case, opening mark, script). Runs of spaceless scripts are cut into
words by a word lattice, of which the likeliest path counts; the dictionary is learned from all texts (runs that are frequent
and free on both sides) and has the closed classes of particles and conjunctions besides. Every gap between words that has
no terminator, with or without a space, is classified by the final particle before it and the opening word after it, by their classes
and by how much oftener than others they stand before and after terminators in the texts. So is what follows a quotation.
In Thai and Lao every space or line break is a gap that ends the sentence.

Defined results for odd input: null, empty and blank texts have no units; a text of any length is read whole;
repeated rows give their units once; rows with a null id give none; further columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.shared import stored, table

Span = tuple[int, int]

# ---------------------------------------------------------------------------------------------------- word lists
#: Shortenings that a name, number or noun follows: a point after one never ends a sentence.
BINDING = frozenset(
    "mr mrs ms messrs dr prof st lt col gen capt cpt sgt maj rev hon pres gov sen rep fr hr hrn frl dipl ing "
    "fig figs sec ch chap vol ed eds pp p pg art par para nr nos abb abs abschn kap bd s str tel ext "
    "vgl bzw ca evtl ggf inkl zzgl exkl geb gest mio mrd std stk sog bspw z d u i e v vs viz cf approx est incl excl resp dept "
    "env réf p.ex m mm mme mlle mlles me pr cie sr sra srta sres dra dres ud uds vd d dn núm núms pág págs cap caps aprox ej mill tít párr vid "
    "рис стр см табл гл ст им ул г-н г-жа проф акад инж др напр т п руб.коп д-р "
    "सं डॉ श्री श्रीमती प्रो पृ क्र د أ ص م deg i.e e.g a.k.a".split()
)
#: Those that are also words: they bind a number, or a name when they have a capital themselves.
_ALSO_WORDS = frozenset("me art par cap rep sec est ing res ed ch pr gen mill ext vol para".split())
#: Shortenings that may stand at the end of a sentence: the next word decides.
LOOSE = frozenset("inc ltd co corp llc plc bros jr sr. etc usw al a.m p.m am pm h min sek hrs hr. kg km cm град млн млрд тыс руб ч мин сек г гг кг км др пр".split())
_MONTHS_DE = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
_DATED = frozenset("am vom bis zum dem den der seit".split())
_BINDING_OR_WORDS, _DATED_OR_MONTHS = BINDING | _ALSO_WORDS, _DATED | _MONTHS_DE
_OPENERS = frozenset("the a an it he she they we you i in on at this that these those there but and or if when what who how was is".split())

#: Closed classes of the spaceless scripts: particles and endings that close a sentence, words that open one, words that lead on from a
#: quotation. All other words are learned from the texts.
FINAL = frozenset("た だ る い かよ ね ぞ な か よ です ます ました ません でした でしょう ましょう だろう だった である という 了 吗 呢 吧 啊 嘛 的 过 ครับ ค่ะ คะ นะ แล้ว ไหม หรือไม่ เลย ด้วย တယ် သည် မည် ပါသည် ပါ ហើយ ទេ".split())
#: Those of them that close a sentence even where no space follows.
FIRM_FINAL = frozenset("です ます ました ません でした でしょう ましょう だろう 吗 呢 吧".split())
OPENING = frozenset("しかし そして また だが なお さらに この その あの それ これ 今 今日 明日 昨日 私 彼 彼女 一方 但是 可是 然后 而且 因此 所以 根据 尽管 难道 不过 于是 我 他 她 那 这 第 今天 明天 昨天 ผล แฟ้ม ไม่มี ใคร สัญญาณ ตัวอย่าง ค่า แต่ และ เมื่อ သို့သော် ထို့ကြောင့် ប៉ុន្តែ ដូច្នេះ".split())
LEADS_ON = frozenset("と って との とは との、 问 問 说 說 道 答 回答 喊 表示 写 写道 称 告诉 解释 补充 กล่าว ถาม ตอบ บอก".split())
_JOINING = frozenset("は が を に で へ も の から まで より ので のに けど 在 把 被 由 为 不 有".split())
_CLOSED = FINAL | OPENING | LEADS_ON | _JOINING
#: Evidence that a word of a closed class gives, in nats; what a side needs, and both sides together.
CLASS_EVIDENCE, SIDE_EVIDENCE, GAP_EVIDENCE, MOST_EVIDENCE = 2.0, 1.0, 4.0, 3.0

#: A learned word has at least this share of the characters of its texts (so a lexicon has a bounded number), and no one character
#: stands before it or after it in more than this part of its places.
WORD_SHARE, TIED = 2e-5, 0.7
_WORD_CHARS, _GRAM_CHARS = 3, 4
_UNKNOWN = -14.0


class Lexicon:
    """Words of the spaceless scripts: log-probability, and how much more often than others they close or open a sentence (nats)."""

    def __init__(self, counts: dict[str, tuple[int, int, int]] | None = None):
        counts = counts or {}
        total = sum(n for g, (n, _, _) in counts.items() if len(g) == 1)
        after: dict[str, int] = {}
        before: dict[str, int] = {}
        for g, (n, _, _) in counts.items():  # particles are words of their own and tie nothing
            if g[-1] not in _CLOSED:
                after[g[:-1]] = max(after.get(g[:-1], 0), n)
            if g[0] not in _CLOSED:
                before[g[1:]] = max(before.get(g[1:], 0), n)
        ends = sum(f for g, (_, f, _) in counts.items() if len(g) == 1) / max(1, total)
        starts = sum(o for g, (_, _, o) in counts.items() if len(g) == 1) / max(1, total)
        self.words: dict[str, tuple[float, float, float]] = {}
        for g, (n, f, o) in counts.items():
            free = after.get(g, 0) <= TIED * n and before.get(g, 0) <= TIED * n and g[0] not in _JOINING and g[-1] not in _JOINING
            if len(g) == 1 or len(g) <= _WORD_CHARS and free or g in _CLOSED:
                self.words[g] = (math.log(n / total), _evidence(f, n * ends), _evidence(o, n * starts))
        least = math.log(WORD_SHARE)
        for g in _CLOSED:
            p, f, o = self.words.get(g, (least, 0.0, 0.0))
            self.words[g] = (p, f + CLASS_EVIDENCE * (g in FINAL), o + CLASS_EVIDENCE * (g in OPENING))
        self.longest = max(map(len, self.words))
        self._gaps: dict[str, tuple[int, ...]] = {}

    def lattice(self, run: str) -> list[str]:
        """The words of a run: the likeliest path through the lattice of all words in it."""
        n = len(run)
        best = [0.0] + [-math.inf] * n
        back = [0] * (n + 1)
        get = self.words.get
        for i in range(n):
            at = best[i]
            for j in range(i + 1, min(n, i + self.longest) + 1):
                word = get(run[i:j])
                if word is not None:
                    p = at + word[0]
                elif j == i + 1:
                    p = at + _UNKNOWN
                else:
                    continue
                if p > best[j]:
                    best[j], back[j] = p, i
        words, j = [], n
        while j:
            words.append(run[back[j] : j])
            j = back[j]
        return words[::-1]

    def closes(self, left: str, right: str, spaced: bool) -> bool:
        """Whether a sentence ends between two words: the final word before the gap and the opening word after it."""
        if not spaced and left not in FIRM_FINAL or right in LEADS_ON or right in _JOINING:
            return False
        none = (_UNKNOWN, 0.0, 0.0)
        final, opening = self.words.get(left, none)[1], self.words.get(right, none)[2]
        return final >= SIDE_EVIDENCE and opening >= SIDE_EVIDENCE and final + opening >= GAP_EVIDENCE

    def gaps(self, stretch: str) -> tuple[int, ...]:
        """The offsets in a stretch of spaceless script (with the spaces inside it) at which a sentence ends without a mark."""
        found = self._gaps.get(stretch)
        if found is None:
            if len(self._gaps) > 100_000:
                self._gaps.clear()
            out, left, at = [], "", 0
            for m in _UNSPACED.finditer(stretch):
                spaced, p = m.start() > at, m.start()
                for word in self.lattice(m.group()):
                    if left and self.closes(left, word, spaced):
                        out.append(at)
                    left, spaced = word, False
                    p += len(word)
                    at = p
            found = self._gaps[stretch] = tuple(out)
        return found


def _evidence(seen: int, expected: float) -> float:
    return max(-MOST_EVIDENCE, min(MOST_EVIDENCE, math.log((seen + 1) / (expected + 1))))


# ---------------------------------------------------------------------------------------------------- characters
_LINE = re.compile(r"[^\n\r\x0b\x0c\x85  ]+")
_BULLET = re.compile(r"\s*[-*•·‣▪◦●○]\s+\S")
_NUMBERED = re.compile(r"\s*\(?(\d{1,3}|[a-zA-Z])[.)]\s+\S")
_FIELD = re.compile(r"\s*[^:;|=：；]{1,40}[:=：]")
_DUMP = re.compile(r"\s*(?:DUMP\b.*|[0-9A-Za-z+/=_-]{60,}|[\d.,;:/|+\s-]{40,})\s*$")
_ENDS = re.compile(r"[.!?…。！？｡।॥؟۔။។៕][\s”’\"»)\]」』“）]*$")
_THAI = re.compile(r"[฀-໿]")  # and Lao, which is spaced like it
_UNSPACED = re.compile(r"[က-႟ក-៿぀-ヿ㐀-鿿]+")
_STRETCH = re.compile(r"[က-႟ក-៿぀-ヿ㐀-鿿]+(?:\s+[က-႟ក-៿぀-ヿ㐀-鿿]+)*")
_SPACELESS = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿]")
_TOKEN = re.compile(r"[.!?…]+|[。！？｡।॥؟۔။។៕]+[.!?…]*|[“”„«»‹›「」『』()（）\[\]\"]")
_GAP = re.compile(r"(\S*)(\s+)(?=(\S+))")
_MIXED = re.compile(r"[a-z]{1,2}[A-Z]")
_TOKEN_EDGES = frozenset("“”„«»([（「『\"")
_LAST_RUN = re.compile(r"(?:[^\W\d_]|[̀-़ͯ-्])+$|\d+$")
_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[^。！？.!?“「『\n]{0,48}")
_PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]"}
_CLOSERS = frozenset("”»›」』)）]“\"’")
_FIRM = frozenset("。！？｡।॥؟۔။។៕")
_STOPS = frozenset(".!?…。！？｡।॥؟۔။។៕")
_BRACKETS = frozenset("(（[")
HEADING_CHARS = 70


def _fields(line: str) -> bool:
    """Whether the line is a record of three or more ``name: value`` fields."""
    parts = [p for p in re.split(r"[;|；]", line) if p.strip()]
    return len(parts) >= 3 and all(_FIELD.match(p) for p in parts)


def _marker(line: str) -> int:
    """The number of a line that begins with a figure or letter and a point or bracket, else 0; letters count from 1,001."""
    m = _NUMBERED.match(line)
    if not m:
        return 0
    return int(m[1]) + 1 if m[1].isdigit() else 1_001 + ord(m[1].lower()) - ord("a") + 100 * m[1].isupper()


def _blocks(text: str, lexicon: Lexicon) -> Iterator[tuple[int, int, bool]]:
    """Stretches that no sentence leaves, and whether one is a unit as it stands."""
    lines: list[tuple[int, int, str]] = []  # "" blank, "w" whole, "t" running text
    at = 0
    for m in _LINE.finditer(text):
        if text.count("\n", at, m.start()) > 1 or lines and " " in text[at : m.start()]:
            lines.append((m.start(), m.start(), ""))
        at = m.end()
        line = m.group()
        if not line.strip():
            lines.append((m.start(), m.start(), ""))
            continue
        whole = bool(_BULLET.match(line) or (";" in line or "|" in line or "；" in line) and _fields(line) or _DUMP.match(line))
        lines.append((m.start(), m.end(), "w" if whole else "t"))
    marks = [_marker(text[s:e]) if kind == "t" else 0 for s, e, kind in lines]
    for k, n in enumerate(marks):
        # a numbered line next to one with the number before or after it is an item of a list
        if n and (k and marks[k - 1] == n - 1 > 0 or marks[k + 1 : k + 2] == [n + 1]):
            lines[k] = (*lines[k][:2], "w")
    start = -1
    for k, (s, e, kind) in enumerate(lines):
        before = lines[k - 1][2] if k else ""
        after = lines[k + 1][2] if k + 1 < len(lines) else ""
        if kind == "t" and start < 0 and before != "t" and e - s <= HEADING_CHARS:
            line = text[s:e]
            if not _ENDS.search(line) and not _THAI.search(line) and not any(lexicon.gaps(m.group()) for m in _STRETCH.finditer(line)):
                # a first line that runs on is a sentence broken by a line end, however short
                if after != "t":
                    kind = "w"
        if kind == "t":
            if start < 0:
                start = s
            end = e
            if after != "t":
                yield start, end, False
                start = -1
            continue
        if start >= 0:
            yield start, lines[k - 1][1], False
            start = -1
        if kind == "w":
            yield s, e, True


def _arcs(text: str, tokens: list[re.Match[str]]) -> list[Span]:
    """Outermost matched quotations and brackets as (open, close); each mark is stacked once for every mark that closes it."""
    stack: list[tuple[str, int]] = []
    open_for: dict[str, list[int]] = {}  # per closing mark the places in the stack that it closes
    spans: list[Span] = []
    for m in tokens:
        c = m.group()
        if c[0] in _STOPS:
            continue
        waiting = open_for.get(c)
        if not waiting:
            closers = '"' if c == '"' else _PAIRS.get(c)
            if closers:
                for x in closers:
                    open_for.setdefault(x, []).append(len(stack))
                stack.append((closers, m.start()))
            continue
        hit = waiting[-1]
        spans.append((stack[hit][1], m.start()))
        while len(stack) > hit:
            for x in stack.pop()[0]:
                open_for[x].pop()
    spans.sort()
    outer: list[Span] = []
    for span in spans:
        if not outer or span[0] > outer[-1][1]:
            outer.append(span)
    return outer


def _opens(text: str, n: int) -> bool:
    """Whether the character at ``n`` can open a sentence: a capital, digit, caseless letter or opening mark."""
    c = text[n]
    if c.islower():
        return bool(_MIXED.match(text, n))
    return c.isalnum() or c in "“„«‹「『(（[\"¿¡'’#§$€№•*" or c == "—" or c == "-" and text[n + 1 : n + 2].isupper()


def _after_point(text: str, start: int, p: int, b: int, n: int) -> bool:
    """Whether the single point at ``p`` (its node ending at ``b``, the next word at ``n``) ends a sentence."""
    nxt = text[n]
    at, far = p, max(start, p - 40)
    while at > far and (c := text[at - 1]) not in _TOKEN_EDGES and not c.isspace():
        at -= 1
    token = text[at:p]
    if token.isalpha():
        last = token
    else:
        run = _LAST_RUN.search(token)
        last = run.group() if run else ""
    if b == n:  # nothing between
        if nxt.isdigit():
            return len(last) >= 3 and last.isalpha() and last.islower() and last not in _BINDING_OR_WORDS and "." not in token and bool(re.match(r"\d+\s", text[n : n + 12]))
        if nxt.islower():
            return len(last) >= 3 and last.isalpha() and "_" not in token and bool(_MIXED.match(text, n))
        if nxt.isupper():
            follow = text[n + 1 : n + 2]
            single = len(last) == 1 and last.isalpha()
            return not single and last.lower() not in BINDING and (not follow or not follow.isupper() and follow != ".") and "_" not in token
        return _opens(text, n) and last.lower() not in BINDING
    if not _opens(text, n):
        return False
    key = (re.split(r"['’]", token)[-1] if "'" in token or "’" in token else token).lower()
    if not key:
        return True
    if key == "no" or key == "nº":
        return not nxt.isdigit()
    if key in _ALSO_WORDS:
        return not nxt.isdigit() and not token[:1].isupper()
    if key in BINDING or last.lower() in BINDING and "." in token and key not in LOOSE:
        return False
    if key in LOOSE:
        return not nxt.islower()
    if "." in key and re.fullmatch(r"[^\W\d_](?:\.[^\W\d_])+", key):  # letters with points
        w = _WORD.match(text, n)
        return bool(w) and w.group().lower() in _OPENERS
    if len(key) == 1 and key.isalpha():
        return not token.isupper() and not key.isascii() and not key.islower()
    if key.isdigit():
        if p - len(key) <= start:
            return False  # the marker of a list item
        if len(key) <= 2:
            w = _WORD.match(text, n)
            if w and w.group().lower() in _MONTHS_DE:
                return False
            before = text[max(start, p - 24) : p - len(key)].split()
            if nxt.isdigit() and before and before[-1].lower() in _DATED_OR_MONTHS:
                return False
    return True


def _leads_on(text: str, b: int, end: int, lexicon: Lexicon) -> bool:
    """Whether the clause after a quotation goes on with it (spaceless scripts)."""
    clause = _CLAUSE.match(text, b, min(end, b + 48))
    run = clause.group() if clause else ""
    words = lexicon.lattice(run)
    return bool(words) and (words[0] in ("と", "って", "との", "とは") or any(w in LEADS_ON and len(w) >= 1 and w not in ("と", "って", "との", "とは") for w in words))


def _split(text: str, s: int, e: int, out: list[Span], lexicon: Lexicon) -> None:
    tokens = list(_TOKEN.finditer(text, s, e))
    arcs = _arcs(text, tokens)
    opens = [a for a, _ in arcs]
    thai = bool(_THAI.search(text, s, e))
    nodes: list[tuple[int, int, str, int]] = []  # candidates: (mark's start, end, mark, its arc)
    for m in tokens:
        p = m.start()
        if text[p] not in _STOPS:
            continue
        if arcs:
            k = bisect_right(opens, p) - 1
            if k >= 0 and arcs[k][1] > p:
                continue
        nodes.append((p, m.end(), m.group(), -1))
    for a, c in arcs:
        i = c - 1
        while i > a and (text[i].isspace() or text[i] in _CLOSERS):
            i -= 1
        if text[i] in _STOPS and (c + 1 >= e or text[c + 1] not in _STOPS):
            nodes.append((i, c + 1, text[i], a))
    if thai:
        for m in _GAP.finditer(text, s, e):
            k = bisect_right(opens, m.start(2)) - 1
            if (k < 0 or arcs[k][1] < m.start(2)) and (_THAI.search(m.group(1)) or _THAI.search(m.group(3))):
                nodes.append((m.start(2), m.start(2), " ", -1))
    for m in _STRETCH.finditer(text, s, e):
        for gap in lexicon.gaps(m.group()):
            at = m.start() + gap
            k = bisect_right(opens, at) - 1
            if k < 0 or arcs[k][1] < at:
                nodes.append((at, at, " ", -1))
    nodes.sort()
    start = s
    while start < e and text[start].isspace():
        start += 1
    for p, b, mark, arc in nodes:
        if b <= start:
            continue
        while b < e and arc < 0 and mark != " " and text[b] in "”»」』’" :
            b += 1
        n = b
        while n < e and text[n].isspace():
            n += 1
        if n >= e:
            break
        if mark == " ":
            pass
        elif arc >= 0:
            if not _opens(text, n) or text[n] in "—-":
                continue
            at_start = arc <= start
            if text[arc] in _BRACKETS:
                if not at_start:
                    continue
            elif _SPACELESS.search(text[n]) or mark in _FIRM or _SPACELESS.search(text, arc, b):
                if text[n] in "とっ" and _leads_on(text, n, e, lexicon) or at_start and n == b and _leads_on(text, n, e, lexicon):
                    continue
        elif mark[0] in _FIRM:
            if text[n] in ",;:，；：、":
                continue
        elif mark[0] == "…" or len(mark) > 1 and set(mark) == {"."} and len(mark) > 2:
            if b == n or not _opens(text, n) or _SPACELESS.search(text[n]):
                continue
        elif mark[0] in "!?" or len(mark) > 1 and set(mark) & {"!", "?"}:
            if not _opens(text, n) or text[n] in "—-" and b != n:
                continue
        elif not _after_point(text, start, p, b, n):
            continue
        end = b
        while end > start and text[end - 1].isspace():
            end -= 1
        if end > start:
            out.append((start, end))
        start = n
    end = e
    while end > start and text[end - 1].isspace():
        end -= 1
    if end > start:
        out.append((start, end))


_CLOSED_CLASSES = Lexicon()


def units(text: str, lexicon: Lexicon = _CLOSED_CLASSES) -> list[Span]:
    """The sentence units of ``text`` as (start, end) code points; they cover all but whitespace between them."""
    out: list[Span] = []
    for s, e, whole in _blocks(text, lexicon):
        if whole:
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1].isspace():
                e -= 1
            if e > s:
                out.append((s, e))
        else:
            _split(text, s, e, out, lexicon)
    return out


# ---------------------------------------------------------------------------------------------------- lexicon
_END_MARKS = np.array([ord(c) for c in "。！？｡။។៕"], dtype=np.uint64)
_GRAM_COLUMNS = "gram long, n long, final long, opening long"


def _gram_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of up to four characters of spaceless scripts (16 bits each), how often, and how often before and after an end mark."""
    for b in batches:
        stretches = [text[max(0, m.start() - 1) : m.end() + 1] for text in b["text"] for m in _UNSPACED.finditer(text)]
        if not stretches:
            continue
        # stretches stand apart by two blanks, so that neighbours of a run are its own
        cp = np.frombuffer(("  " + "  ".join(stretches) + "  ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        inside = (cp >= 0x1000) & (cp <= 0x109F) | (cp >= 0x1780) & (cp <= 0x17D3) | (cp >= 0x3041) & (cp <= 0x30FF) | (cp >= 0x3400) & (cp <= 0x9FFF)
        inside &= ~np.isin(cp, _END_MARKS)
        ends = np.isin(cp, _END_MARKS)
        key, whole = np.zeros(len(cp), np.uint64), np.ones(len(cp), bool)
        keys, finals, openings = [], [], []
        for n in range(_GRAM_CHARS):
            size = len(cp) - n - 1
            whole = whole[:size] & inside[n : n + size]
            key = key[:size] | cp[n : n + size] << np.uint64(48 - 16 * n)
            at = np.flatnonzero(whole)
            keys.append(key[at])
            finals.append(ends[at + n + 1])
            openings.append(ends[at - 1])
        gram, place = np.unique(np.concatenate(keys), return_inverse=True)
        count = lambda w: np.bincount(place, w, len(gram)).astype(np.int64)
        yield pd.DataFrame({"gram": gram.view(np.int64), "n": count(None), "final": count(np.concatenate(finals)), "opening": count(np.concatenate(openings))})


def learn(items: DataFrame) -> Lexicon:
    """The lexicon of all texts of ``items``: runs of ``WORD_SHARE`` of the characters, so at most 1 / WORD_SHARE of each length."""
    rows = items.where("text is not null").select("text").mapInPandas(_gram_rows, _GRAM_COLUMNS)
    counts = stored(rows.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("n", "final", "opening")]))
    total = counts.where(F.col("gram").bitwiseAND(F.lit((1 << 48) - 1)) == 0).agg(F.sum("n").alias("n")).first().n or 0
    found = {}
    for r in counts.where(F.col("n") >= max(2.0, WORD_SHARE * total)).toLocalIterator():
        bits = r.gram & (1 << 64) - 1
        found["".join(chr(c) for k in (48, 32, 16, 0) if (c := bits >> k & 0xFFFF))] = (r.n, r.final, r.opening)
    return Lexicon(found)


def _unit_rows(lexicon: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = lexicon.value
        for b in batches:
            found = [units(t, words) for t in b["text"]]
            yield pd.DataFrame({"tbl": b["tbl"], "item_id": b["item_id"], "starts": [[s for s, _ in u] for u in found], "ends": [[e for _, e in u] for u in found]})

    return rows


def sentence_units(items: DataFrame) -> DataFrame:
    """(tbl, item_id, char_start, char_end) of ``items(tbl, item_id, text)``; equal rows of an item count once."""
    texts = items.where("item_id is not null and text is not null").select("tbl", "item_id", "text")
    lexicon = items.sparkSession.sparkContext.broadcast(learn(texts))
    rows = texts.mapInPandas(_unit_rows(lexicon), "tbl string, item_id string, starts array<int>, ends array<int>")
    # the offsets of a text stay together until repeated rows are gone: one shuffled row per text, not per sentence
    once = rows.dropDuplicates()
    unit = F.explode(F.arrays_zip("starts", "ends")).alias("u")
    return once.select("tbl", "item_id", unit).select("tbl", "item_id", F.col("u.starts").alias("char_start"), F.col("u.ends").alias("char_end")).dropDuplicates()


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, item_id, text) of documents and chunks."""
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").cast("string").alias("item_id"), "text")
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("item_id"), "text")
    return docs.unionByName(chunks)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence units of every document and chunk."""
    return sentence_units(texts(spark, sf_dir))


def p1_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and their mean and greatest length per table and source language label."""
    found = p1_found(spark, sf_dir)
    return found.groupBy("tbl").agg(F.count("*").alias("n_units"), F.countDistinct("item_id").alias("n_items"), F.avg(F.col("char_end") - F.col("char_start")).alias("mean_chars"), F.max(F.col("char_end") - F.col("char_start")).alias("max_chars"))


QUERIES = {"p1_found": p1_found, "p1_lengths": p1_lengths}
SQL: dict[str, str] = {}
