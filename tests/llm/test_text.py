"""Sentences, format duplicates, splitting, answers and abuse on small fixtures."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import abuse, answers, format_dups, sentences, splitting

CASES = [
    ("See Fig. 4 and Sec. 4.2 by J. K. Catel. Costs came to $ 8.2 million, incl. freight. Done.", 3),
    ("The crew left at 4 p.m. Nothing else was written down.", 2),
    ("eLog entries stop at 03:15 a.m. and resume later. pH dropped to 3.8 before the line stopped.", 2),
    ("“Nobody touched it. I would have seen it,” said Ann Bo. Next one.", 2),
    ("He left a reply: “No.” Version 4.6.4 was active, i.e. the old one.", 2),
    ("He wrote “done.” and closed the folder. (The second page, signed by X, is blank.) End.", 3),
    ("The file was sold to Acme Holdings Ltd. The buyer has not replied. Smith et al. estimate 3.", 3),
    ("A copy is kept as report_v6.3.pdf on the drive.No fault was found. 243 calls came.", 3),
    ("Am 7. Mai kam z. B. niemand zur Übergabe. Am 1. Juli fehlten 3,5 Mio. Euro u. a. in der Kasse.", 2),
    ("„Gut“, sagte er, „aber wer zahlt? Nicht wir.“ Hr. Maier schrieb nur „Nein.“ an den Rand.", 2),
    ("« D'accord », a répondu Jo, « mais qui paie ? Pas nous. » Voir fig. 8 et chap. 6. Mme. Roy attend à 9 h. Fin.", 4),
    ("«Yo no toqué nada. Pregunten al turno», dijo Ana. ¡Eso contradice a la Sra. Paz! ¿Quién firmó?", 3),
    ("«Хорошо, — ответил он, — но кто платит? Не мы». См. рис. 3 на стр. 5. Инженер А. П. Петров ушёл.", 3),
    ("“谁签的字？”王五问了两次。李四说：“我没有碰过它。去问夜班吧。”屏幕过了5分钟……然后黑了。", 3),
    ("「私は触っていない。夜勤に聞いてくれ」と彼は言った。封印は無事だったのか？はい。", 3),
    ("ผลตรวจขาดไป5รายการ ไม่มีใครอธิบายได้\nตัวอย่างถูกเก็บไว้", 3),
    ("नमूना 5.92 डिग्री पर रखा गया। रसीद सं. 133 पर किसने हस्ताक्षर किए?", 2),
    ("قيم د. سامي النتيجة بدرجة 4.39. هل رأى الختم؟ قال: «لم ألمس شيئا. اسألوا الليل».", 3),
    ("Annex 4: open questions\n\nsite: A; item: B; reading: 5 kPa\n• First point. Second half\n• Another\n\nA line that\nis wrapped ends here. And one\nmore.", 6),
    ("DUMP 12345 12345 12345\nText one. Text two.", 3),
    ("Horny and alone, come and ride me. Maintenance sheets mention it. Me. Dupont est venu.", 3),
    ("今日は雨が降りました明日は晴れるでしょう", 2),
    ("他走了 但是我留下了 因此没有人知道", 3),
    ("他说他走了 的时候没有人", 1),
    ("1. Buy milk\n2. Buy eggs", 2),
    ("a) one thing. Or two\nb) another thing", 2),
    ("On the list of 4 May the figure is\n5. It was checked.", 2),
    ("ຂ້ອຍໄປ ລາວມາ", 2),
    ("ខ្ញុំទៅ។ គាត់មក។", 2),
    ("သူသွားတယ်။ ငါနေတယ်။", 2),
    ("ผลตรวจขาด ไม่มีใคร 他走了 但是我留下了", 4),
    ("", 0),
    ("  \n \t ", 0),
    ("One", 1),
]


@pytest.mark.parametrize(("text", "n"), CASES)
def test_units(text, n):
    got = [text[s:e] for s, e in sentences.units(text)]
    assert len(got) == n, got


def test_units_cover_the_text_in_any_mess():
    rng = random.Random(4)
    alphabet = list("ab AB1.!?\n “”„«»()「」。ก ย\t'’-;:|…") + ["Dr.", "z. B.", " - ", "\n\n"]
    for _ in range(400):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))
        at = 0
        for s, e in sentences.units(t):
            assert s >= at and e > s and not t[at:s].strip() and t[s:e] == t[s:e].strip()
            at = e
        assert not t[at:].strip()


@pytest.mark.parametrize("marks", ["(", "()", "“", "„“”", '"', "(。"])
def test_many_brackets_take_linear_time(marks):
    began = time.monotonic()
    sentences.units((marks * 100_000)[:100_000])
    assert time.monotonic() - began < 3


def test_the_lattice_learns_words_and_what_closes_and_opens_a_sentence(spark):
    rng = random.Random(2)
    nouns, ends, starts = ["森林", "海洋", "工場", "水槽", "倉庫"], ["終わり", "止まり"], ["突如", "翌朝"]
    texts = ["".join(rng.choice(starts) + rng.choice(nouns) + "は" + rng.choice(nouns) + "で" + rng.choice(ends) + "。" for _ in range(4)) for _ in range(300)]
    lexicon = sentences.learn(spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string"))
    assert lexicon.lattice("翌朝倉庫は水槽で終わり") == ["翌朝", "倉庫", "は", "水槽", "で", "終わり"]
    assert lexicon.words["止まり"][1] > 2 and lexicon.words["突如"][2] > 2 and lexicon.words["海洋"][1] < 0
    line = "翌朝倉庫は水槽で終わり 突如森林は海洋で止まり"
    assert [line[s:e] for s, e in sentences.units(line, lexicon)] == line.split() and len(sentences.units(line)) == 1
    assert sentences.learn(spark.createDataFrame([], "text string")).words.keys() == sentences.Lexicon().words.keys()


def test_sentence_rows_take_odd_input(spark):
    rows = [("documents", "1", "One. Two."), ("documents", "1", "One. Two."), ("documents", "2", None), ("documents", None, "x."), ("chunks", "3", ""), ("chunks", "4", "a" * 300_000 + ". B.")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "tbl string, item_id string, text string, char_start string")
    got = {tuple(r) for r in sentences.sentence_units(df).collect()}
    assert got == {("documents", "1", 0, 4), ("documents", "1", 5, 9), ("chunks", "4", 0, 300_001), ("chunks", "4", 300_002, 300_004)}
    assert sentences.sentence_units(df.limit(0)).count() == 0


# ------------------------------------------------------------------------------------------ p2
SAME = ["Der Straße-Test: 3,5 kPa", "der STRASSE test 3,5 KPA!", "Ｄｅｒ Straße­Test".replace("­", " ") + " 3,5 kPa", "„Der Straße – Test“ 3,5 kPa…", "De​r Straße\nTest 3,5 kPa"]


def test_canonical_forms():
    assert len({format_dups.canonical(t) for t in SAME}) == 1
    assert format_dups.canonical("a 3,5")[0] != format_dups.canonical("a 35")[0]
    assert format_dups.canonical("a 3.5")[0] != format_dups.canonical("a 3,5")[0]
    assert format_dups.canonical("café")[0] == format_dups.canonical("CAFÉ")[0]
    a, b = format_dups.canonical("site: A; item: B C; n = 5"), format_dups.canonical("N=5|Item: b c|SITE : a")
    assert a[1] == b[1] is not None and a[0] != b[0]
    assert format_dups.canonical("a: b; c: d")[1] is None and format_dups.canonical("x; y; z: q")[1] is None


def test_copies_and_counts(spark):
    items = [("data_points", f"d{i}", t) for i, t in enumerate(SAME)] + [("data_points", "d0", SAME[0]), ("data_points", "e", None), ("data_points", None, "x"), ("hypotheses", "d9", SAME[0]), ("data_points", "f1", "site: A; item: B; n: 5"), ("data_points", "f2", "n: 5; site: A; item: B"), ("data_points", "f3", "site A, item B, n 5"), ("data_points", "g1", ""), ("data_points", "g2", "...")]
    df = spark.createDataFrame([(*r, "clash") for r in items], "tbl string, id string, text string, key string")
    got = {tuple(r) for r in format_dups.copies(df).collect()}
    want = {("data_points", "d0", f"d{i}") for i in range(1, len(SAME))} | {("data_points", "f1", "f2"), ("data_points", "f1", "f3"), ("data_points", "g1", "g2")}
    assert got == want
    counts = {(r.tbl, r.rep_id): r.n_copies for r in format_dups.copy_groups(df).collect()}
    assert counts["data_points", "d0"] == len(SAME) and counts["hypotheses", "d9"] == 1
    assert format_dups.copies(df.limit(0)).count() == 0


def test_records_of_fields_have_a_check_of_their_own(spark):
    rows = [("t", f"d{i}", t) for i, t in enumerate(["a: 1; b: 2; c: 3", "c: 3; b: 2; a: 1", "a: 1; b: 2; c: 4"])]
    keyed = {r.id: r.check for r in format_dups._parts(spark.createDataFrame(rows, "tbl string, id string, text string"))[0].collect()}
    assert keyed["d0"] == keyed["d1"] != keyed["d2"] and min(keyed.values()) > 0


def test_a_third_of_all_rows_may_be_copies(spark):
    df = spark.range(9_000).select(F.lit("t").alias("tbl"), F.format_string("%05d", "id").alias("id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("Same text"), F.repeat(F.lit(" "), (F.col("id") % 5).cast("int")))).otherwise(F.concat(F.lit("other "), F.col("id"))).alias("text"))
    got = format_dups.copies(df)
    assert got.count() == 2_999 and {r.id_a for r in got.select("id_a").distinct().collect()} == {"00000"}


# ------------------------------------------------------------------------------------------ p4
def test_cuts_cover_overlap_and_stay_within():
    rng = random.Random(5)
    text = " ".join(" ".join("word%d" % rng.randint(0, 99) for _ in range(rng.randint(3, 20))).capitalize() + rng.choice([".", "!", ".\n\n"]) for _ in range(300))
    for limit, overlap in ((500, 50), (900, 0), (300, 299), *((200, k) for k in range(0, 101, 10))):
        got = splitting.cuts(text, limit, overlap)
        real = min(overlap, limit // 2)
        assert got[0][0] == 0 and got[-1][1] == len(text) and all(0 < e - s <= limit for s, e in got)
        assert all(b[0] == a[1] - real for a, b in zip(got, got[1:], strict=False))
    ends = {e for _, e in sentences.units(text)}
    assert sum(e in ends for _, e in splitting.cuts(text, 900, 50)) >= 0.9 * len(splitting.cuts(text, 900, 50))


def test_an_edit_moves_neighbouring_pieces_only():
    rng = random.Random(6)
    text = " ".join(" ".join("w%d" % rng.randint(0, 999) for _ in range(12)) + "." for _ in range(400))
    before = {text[s:e] for s, e in splitting.cuts(text, 1200, 100)}
    edited = text[:3000] + "An inserted remark here. " + text[3000:]
    after = [edited[s:e] for s, e in splitting.cuts(edited, 1200, 100)]
    assert sum(p not in before for p in after) <= 5 < len(after) - 8


def test_pieces_take_odd_input(spark):
    long = "x" * 50
    items = spark.createDataFrame([("documents", "1", None, long, "c"), ("documents", "1", None, long, "c"), ("documents", "2", 1, "short", "c"), ("documents", None, 1, long, "c"), ("chunks", "3", 4, "a b " * 10, "c"), ("chunks", "4", 1, None, "c"), ("other", "5", 1, long, "c")], "tbl string, item_id string, ord int, text string, piece_no string")
    limits = spark.createDataFrame([("documents", 20, 5), ("documents", 30, 9), ("chunks", 15, None), ("other", None, 1)], "tbl string, max_chars int, overlap_chars int")
    got = splitting.pieces(items, limits).collect()
    assert {(r.tbl, r.item_id) for r in got} == {("documents", "1"), ("chunks", "3")}
    mine = sorted((r.piece_no, r.text) for r in got if r.item_id == "1")
    assert all(len(t) <= 20 for _, t in mine) and [k for k, _ in mine] == list(range(len(mine)))
    assert "".join([mine[0][1]] + [t[5:] for _, t in mine[1:]]) == long
    assert [r.piece_ord for r in sorted(got, key=lambda r: r.piece_no) if r.item_id == "3"][:2] == [4, 5]
    assert splitting.pieces(items.limit(0), limits).count() == 0 and splitting.pieces(items, limits.limit(0)).count() == 0


# ------------------------------------------------------------------------------------------ p7
HYP = {"en": "The losses at Dell came from pump AB-1234, since the seal had worn through.", "de": "Die Verluste in Dell kommen von Pumpe AB-1234, weil die Dichtung verschlissen war."}
GOOD = {
    "en": ["If the claim holds, the reading at Dell becomes clearly more likely.", "The claim says nothing about the alarm.", "I cannot see the figure shifting either way, as the keys were out of reach that night.", "no bearing", "The record is silent on the mechanism, so the figure stays at its base rate."],
    "de": ["Trifft die Hypothese zu, wird der Messwert in Dell deutlich wahrscheinlicher.", "Für den stillen Alarm ändert die Hypothese nichts.", "kein Bezug", "Ein Verlust passt gut zur Hypothese, weil die Schlüssel nachts nicht greifbar waren."],
}


def judge():
    rows = [(t, lang) for lang, ts in GOOD.items() for t in ts] * 12 + [(t, lang) for lang, t in HYP.items()] * 5
    return answers.Judge(answers.LanguageModel(rows), answers.EndModel([t for t, _ in rows]))


def test_defects_one_by_one():
    j = judge()
    ask = lambda why, change="more", verdict="supports", lang="en", dp="Two samples taken near pump AB-1234 in Dell differ by 5 crates.": j.defect(change, verdict, why, HYP[lang], lang, dp)
    for lang, texts in GOOD.items():
        for t in texts:
            assert ask(t, lang=lang) is None, t
    for t in (None, "", " ", "​", "N/A", "{}", "—", '""', "(none)", "...", "<empty>", "null" + "." * 50, "-" * 60 + "none"):
        assert ask(t) == "empty", t
    assert ask("Fine, it fits the claim well.", change=None) == "empty" and ask(GOOD["en"][0], verdict="-") == "empty"
    for t in ("I am unable to help with that request.", "Diese Anfrage muss ich ablehnen.", "Je dois refuser cette comparaison.", "Lo siento, no puedo valorar esta afirmación.", "As a language model I do not judge claims about Dell."):
        assert ask(t) == "refusal", t
    assert ask(GOOD["en"][0], change="cannot_say") == "refusal"
    for t in (HYP["en"], HYP["en"].upper(), "The question is whether " + HYP["en"], "> Two samples taken near pump AB-1234 in Dell differ by 5 crates", HYP["en"] + " Two samples taken near pump AB-1234 in Dell differ by 5 crates."):
        assert ask(t) == "copy", t
    for t in ("If the claim holds, the reading at De", "The claim says noth...", 'If the claim holds, the rea"}', '{"change": "more", "why": "The claim sa'):
        assert ask(t) == "truncated", t
    assert ask(GOOD["en"][0], change="unch") == "truncated" and ask(GOOD["en"][0], verdict="strongly_") == "truncated"
    assert ask(GOOD["de"][0]) == "language" and ask(GOOD["en"][0], lang="de") == "language"
    assert ask('{"change": "more", "why": "The claim says nothing about the alarm."}') is None


def test_answers_together_are_read_once(monkeypatch):
    j, folds = judge(), []
    fold = answers.folded
    monkeypatch.setattr(answers, "folded", lambda text: folds.append(text) or fold(text))
    whys = [*GOOD["en"], *GOOD["de"], HYP["en"], "The question is whether " + HYP["en"], "Für den stillen Alarm ändert die", "The claim says noth...", "", None, "I cannot say."]
    rows = [("more", "supports", why, HYP["en"], "en", f"Zwei Proben nahe Pumpe {n} wichen ab, wie ein später Prüfer sah: drei Kisten fehlten.") for n in range(50) for why in whys]
    got = j.defects(rows)
    assert len(folds) < 2 * len(whys) + 150  # words, not every answer and data point
    assert got == [judge().defect(*row) for row in rows[: len(whys)]] * 50 and set(got) == {None, "empty", "refusal", "copy", "truncated", "language"}
    assert j.defects([]) == []


def test_shortcuts_read_texts_as_the_plain_rules_do():
    r = random.Random(7)
    parts = ["a", "B", "CD", "7", "٣", "ſ", "ß", "Σ", "\u0327", "ﬁ", "ไทย", "屏幕", " ", " ", ". ", "...", "…", ",", "-", "}", '"', "” ", "“", "_", "\u200b", "\n", " Foo Bar", "AB-12", "’"]
    name = re.compile(r"[A-Z]{1,3}[-‑–/ ]?\d+|(?<=[^.!?\s] )[A-Z][\w’']+(?: [A-Z][\w’']+)*|\d[\d.,:/-]*")
    finished = re.compile(r"[.!?。！？।؟][”\"»)」\]’']*$")
    for _ in range(3_000):
        t = "".join(r.choices(parts, k=r.randint(0, 25)))
        assert answers._NAME.sub(" ", t) == name.sub(" ", t)
        assert answers._letters(t) == answers._OTHER.sub("", format_dups.folded(t))
        body = answers._CUT_MARKS.sub("", t.strip()).rstrip()
        assert answers._open_end(t) == (None if finished.search(body) else body)
        why, hyp = ("".join(r.choices("ab", k=r.randint(20, 40))) for _ in range(2))
        n = len(why) - 4
        misses = sum(why[i : i + 5] not in hyp for i in range(n))
        assert answers.is_copy(why, hyp, "") == (misses <= min(n - answers.COPY_SHARE * n, answers.COPY_FRAME + 0.1 * n))


def test_defect_rows_take_odd_input(spark):
    lift = [("h", "d", "m", "more", "supports", GOOD["en"][0]), ("h", "d2", "m", None, "supports", "x"), ("h", "d2", "m", None, "supports", "x"), (None, "d", "m", None, None, None), ("gone", "gone", "m", "more", "supports", ""), ("h", "d3", "m", "more", "supports", "a " * 50_000)]
    cols = "hyp_id string, dp_id string, model string, change string, verdict string, rationale string"
    hyps = spark.createDataFrame([("h", HYP["en"], '{"lang": "en"}', "c")], "hyp_id string, text string, meta string, defect string")
    dps = spark.createDataFrame([("d", "Two samples."), ("d", "Two samples."), (None, None)], "dp_id string, text string")
    docs = spark.createDataFrame([(1, "Ein Text.", "de"), (2, None, None)], "doc_id long, text string, lang string")
    df = spark.createDataFrame([(*r, "c") for r in lift], cols + ", dp string")
    got = {tuple(r) for r in answers.defects(df, hyps, dps, docs).collect()}
    assert {("h", "d2", "m", "empty"), ("gone", "gone", "m", "empty")} <= got and not any(r[1] == "d" for r in got)
    assert answers.defects(df.limit(0), hyps.limit(0), dps.limit(0), docs.limit(0)).count() == 0


# ------------------------------------------------------------------------------------------ p10
def test_hidden_spellings_are_read():
    assert abuse.words("You w0rthl3ss i-d-i-o-t, you stuuuupid R​AT") == ["you", "worthles", "idiot", "you", "stupid", "rat"]
    assert abuse.words("pump TF-9831 at 03:15, v6.3") [:1] == ["pump"] and "**" in "".join(abuse.words("that f***h"))


def corpus(seed, n):
    rng = random.Random(seed)
    insult = ["You pathetic clown, crawl back under {} and stay there.", "{} is too ugly and too dense to live.", "Only a moron like {} would sign that."]
    hate = ["All {} are vermin and should be driven out.", "Never trust a {}, that filth is born to lie."]
    sober = ["The process was killed by the watchdog.", "A complaint about insulting remarks by the foreman was settled.", "The plan was called a killer idea and shot down.", "The clinic runs breast screening.", "The stupid-proof latch held.", "The pump at {} was replaced.", "Nobody at {} answered."]
    out = []
    for i in range(n):
        s = [rng.choice(sober).format("N%d" % rng.randint(0, 400)) for _ in range(rng.randint(2, 7))]
        kind = rng.choice(["clean", "clean", "abusive", "hateful"])
        if kind != "clean":
            s.insert(rng.randint(0, len(s)), rng.choice(insult if kind == "abusive" else hate).format("N%d" % rng.randint(0, 400)))
        out.append((i, " ".join(s), kind))
    return out


def test_held_out_accuracy_and_location():
    model = abuse.fit([(t, {k: 1}) for _, t, k in corpus(1, 250)])
    right = 0
    test = corpus(2, 200)
    for _, t, kind in test:
        hits = {(c, t[s:e]) for s, e in sentences.units(t) for c, z in zip(abuse.CATEGORIES, model.logits(t[s:e]), strict=True) if z > 0}
        found = {c for c, _ in hits}
        right += found == ({kind} - {"clean"})
        assert all("clean" != kind and any(w in x for w in ("clown", "ugly", "moron", "vermin", "filth")) for _, x in hits) or kind == "clean" or not hits
    assert right >= 0.93 * len(test)


def test_scores_take_odd_input(spark):
    docs = spark.createDataFrame([(1, "You pathetic idiot, shut up, you worthless rat.", " Open Board ", "c"), (2, None, None, "c"), (3, "", "x", "c"), (None, "You idiot.", "x", "c"), (4, "fine " * 60_000, "x", "c"), (1, "You pathetic idiot, shut up, you worthless rat.", " Open Board ", "c")], "doc_id long, text string, source string, score string")
    labels = spark.createDataFrame([(1, "a", "abusive"), (3, "b", "unsure"), (None, "b", "clean"), (9, "b", "clean")], "doc_id long, annotator string, label string")
    for lab in (labels, labels.limit(0)):
        got = {(r.doc_id, r.category): r for r in abuse.scored(docs, lab).collect()}
        assert len(got) == 12 and got[1, "abusive"].top_sentence_score > 0.5 and got[1, "abusive"].source == "open_board"
        assert got[2, "abusive"].score == 0 and got[3, "sexual"].char_start is None and got[4, "hateful"].top_sentence_score < 0.5
    assert abuse.scored(docs.limit(0), labels).count() == 0




def test_answer_models_count_all_rows(spark):
    docs = spark.range(5_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the pump of hall "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    hyps = spark.createDataFrame([("h", "The seal failed.", "en")], "hyp_id string, text string, lang string")
    told = ["It fits the log at 7 pm", "it fits the log", '{"why": "die Halle war leer"}', "Sí", "", "a b ", "屏幕过了5分钟", "x" * 60, "It fits the log."]
    lift = spark.createDataFrame([("h", f"d{i}", "m", t) for i, t in enumerate(told * 7)], "hyp_id string, dp_id string, model string, rationale string")
    judge = answers.fit(lift, hyps, docs)
    assert dict(zip(judge.languages.languages, judge.languages.rows, strict=True)) == {"en": 5_001 + 7 * len(told)}
    inner = [answers.rationale_of(t)[0] for t in told * 7]
    by_text = answers.EndModel([t for t in inner if t])
    assert all(judge.ends.likelihood(t) == by_text.likelihood(t) for t in map(answers._open_end, inner) if t)
    want = sum(np.bincount(answers._gram_buckets(answers._plain(t)), minlength=answers._BUCKETS) for t in told)
    assert (answers._gram_counts([answers._plain(t) for t in told]) == want).all()
