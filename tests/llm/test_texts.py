import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfold.llm import mixing, mojibake, tokens

PATH = os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.json")
needs_files = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def own(texts):
    flat, counts = tokens.encoder(PATH).encode(texts)
    ends = np.cumsum(counts)
    return [flat[e - c : e].tolist() for e, c in zip(ends, counts)]


@needs_files
@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text("ab \n\t'", max_size=60)), max_size=6))
def test_same_ids_as_the_public_tokenizer(public, texts):
    assert own(texts) == [public(t) if t else [] for t in texts]


@needs_files
def test_long_and_odd_texts(public):
    random.seed(1)
    texts = ["a" * 5000, " " * 3001 + "x", "<|endoftext|> kept", "naïve — “quotes” 日本語 🚲🏽", "\r\n\n  \t", "".join(random.choice("abcdefgh") for _ in range(20_000)), "é" * 999, "\u0000\x85"]
    assert own(texts) == [public(t) for t in texts]


@needs_files
def test_forgetting_words_changes_nothing(public, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 3)
    for t in ("one two three four five", "six seven one two", ""):
        assert own([t, None, t]) == [public(t), [], public(t)]


@needs_files
def test_frames(spark, public):
    df = spark.createDataFrame([(1, "hello world", 3), (2, None, 4), (3, "", 5), (1, "hello world", 3), (4, "  ", None)], "doc_id long, text string, ids int")
    got = sorted((r["doc_id"], r["ids"]) for r in tokens.encode_texts(df, "doc_id", "text").collect())
    assert got == [(1, public("hello world"))] * 2 + [(2, []), (3, []), (4, public("  "))]
    n = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df, ["doc_id"], "text").collect()}
    assert n == {1: 2, 2: 0, 3: 0, 4: len(public("  "))}
    assert tokens.encode_texts(df.limit(0), "doc_id", "text").collect() == []


def fill(shares, total):
    return {s.source: s for s in mixing.water_fill([mixing.Share(*s) for s in shares], total)}


def test_water_filling():
    s = fill([("a", 1.0, 1, 100), ("b", 1.0, 3, 100), ("c", 2.0, 1, 1000), ("none", 1.0, 5, 0)], 800)
    assert s["a"].target == 100 and s["none"].target == 0 and s["b"].target == pytest.approx(700 / 3) and s["c"].target == pytest.approx(1400 / 3)
    assert (s["b"].whole, s["b"].rest) == (2, pytest.approx(700 / 3 - 200)) and s["c"].whole == 0
    over = fill([("a", 1.0, 2, 10), ("b", 3.0, 1, 10)], 1000)
    assert over["a"].target == 20 and over["b"].target == 10 and over["a"].whole == 2 and over["a"].rest == 0
    assert sum(x.target for x in fill([("a", 5.0, 9, 70), ("b", 1.0, 9, 30)], 240).values()) == pytest.approx(240)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 4), st.integers(0, 500)), min_size=1, max_size=7), st.integers(0, 3000))
def test_filled_shares_are_feasible_and_proportional(rows, total):
    s = mixing.water_fill([mixing.Share(str(i), float(w), m, n) for i, (w, m, n) in enumerate(rows)], total)
    assert all(x.target <= x.available * x.max_repeat + 1e-6 for x in s)
    assert sum(x.target for x in s) == pytest.approx(min(total, sum(x.available * x.max_repeat for x in s)))
    free = [x.target / x.weight for x in s if x.target < x.available * x.max_repeat - 1e-6]
    assert not free or max(free) == pytest.approx(min(free))
    assert all(x.target / x.weight <= min(free) + 1e-6 for x in s) if free else True


def test_mix_against_a_plain_pass(spark, monkeypatch):
    random.seed(5)
    rows = [(i, random.choice(["big"] * 6 + ["mid", "low", None, "other"]), random.choice([0, *range(1, 60)]), "x") for i in range(2000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, repeats string")
    targets = spark.createDataFrame([("big", 2.0, 1), ("mid", 3.0, 2), ("low", 5.0, 3), ("gone", 1.0, 2), (None, 4.0, 1), ("big", 1.0, 9), ("bad", -1.0, 1), ("nan", float("nan"), 1), ("zero", 1.0, 0)], "source string, weight double, max_repeat int")
    for bits in (12, 2):
        monkeypatch.setattr(mixing, "BITS", bits)
        shares = mixing.plan_mix(sized, targets, 30_000)
        out = mixing.mix(sized, shares, "doc_id").collect()
        hashes = {r["doc_id"]: r["h"] for r in sized.select("doc_id", F.xxhash64(F.lit(7), F.col("doc_id").cast("string")).alias("h")).collect()}
        want = set()
        for s in shares:
            docs = sorted(((hashes[i] % 2**64, i, n) for i, src, n, _ in rows if src == s.source and n), key=lambda d: d[:2])
            run = 0
            for _, i, n in docs:
                extra = s.rest > 0 and run + n / 2 <= s.rest
                run += n
                if s.whole + extra:
                    want.add((i, s.whole + extra))
        assert {(r["doc_id"], r["repeats"]) for r in out} == want and len(out) == len(want)
    rep = {r["source"]: r for r in mixing.mix_report(mixing.mix(sized, shares, "doc_id"), shares).collect()}
    by = {s.source: s for s in shares}
    assert set(rep) == {"big", "mid", "low", "gone", }
    assert all(abs(rep[k]["used_tokens"] - by[k].target) <= 60 and rep[k]["most_repeats"] <= by[k].max_repeat for k in rep)
    assert sum(r["actual_share"] for r in rep.values()) == pytest.approx(1.0)
    empty = mixing.mix(sized.limit(0), mixing.plan_mix(sized.limit(0), targets), "doc_id")
    assert empty.collect() == [] and mixing.mix(sized, mixing.plan_mix(sized, targets.limit(0)), "doc_id").collect() == []


SENTENCES = ["Le café de la forêt a été fermé, naïvement.", "Die Brücke über den Fluß wäre gehört.", "It’s “good enough” — isn’t it, the crew’s idea…", "Przebieg zakończył się, różnica wynosi część.", "Жители спрашивают, почему на перекрёстке нет светофора.", "Οι κάτοικοι ρωτούν γιατί η διασταύρωση δεν έχει φανάρι.", "El número de empleos después será mañana, quedó así.", "区域から到達できる職場は増える。住民は理由を尋ねた。"]
DECOYS = ["ÂGE MOYEN, CHÂTEAU, PÂQUES, ÃO", "ATENÇÃO: A REVISÃO DA RUA DA MANHÃ", "plate Ð-41 and stop Þ-7, Ålund side, ¿norte?", "d²x/dt² £5 §3.1 ¶ †", "mood: 🚲🚦 and 👩‍👧", "«État» “É”…", "plain text", "d’été ‘x’ 7° ± 4 %"]


@pytest.fixture(scope="module")
def finder():
    from collections import Counter

    words, chars = Counter(), Counter()
    for s in SENTENCES * 30 + DECOYS * 3:
        words.update(mojibake.words_of(s))
        chars.update({c for c in s if not c.isascii()})
    extra = [chr(c) for c in range(0xA0, 0x180)]
    return mojibake.Finder([c for c, _ in chars.most_common()] + extra, dict(words))


@pytest.mark.parametrize("read", ["cp1252", "latin_1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850"])
def test_utf8_misread_is_found_and_restored(finder, read):
    for s in SENTENCES:
        bad = mojibake.misread(s, "utf_8", read)
        assert finder.garbled(bad) >= 3 and finder.restore(bad) == s
        mixed = "Vu déjà à Łódź: " + bad
        assert finder.restore(mixed) == "Vu déjà à Łódź: " + s


@pytest.mark.parametrize("read", ["cp1252", "latin_1", "cp1251"])
def test_twice_misread(finder, read):
    for s in SENTENCES[:3]:
        bad = mojibake.misread(mojibake.misread(s, "utf_8", read), "utf_8", read)
        assert finder.garbled(bad) >= 3 and finder.restore(bad) == s


@pytest.mark.parametrize("written,read,which", [("cp1251", "koi8_r", 4), ("koi8_r", "cp1251", 4), ("cp1251", "cp1252", 4), ("cp866", "cp1251", 4), ("cp1253", "cp1252", 5), ("cp1252", "cp437", 0), ("cp1252", "mac_roman", 6), ("mac_roman", "cp1252", 0), ("cp1250", "cp1252", 3), ("cp1250", "cp1251", 3), ("cp850", "cp1252", 1), ("cp932", "cp1252", 7)])
def test_legacy_misread_is_found(finder, written, read, which):
    bad = mojibake.misread(SENTENCES[which], written, read)
    assert finder.garbled(bad) >= 3
    if written != "cp932":
        good = finder.restore(bad)
        assert sum(a == b for a, b in zip(good, SENTENCES[which])) >= 0.9 * len(good)


def test_proper_texts_are_left_alone(finder):
    for s in SENTENCES + DECOYS + ["", "ascii only", "é", "Ã", "x\xa0y"]:
        assert finder.garbled(s) < 3 and finder.restore(s) == s
    assert finder.garbled("le r�seau propos� ét�") == 3


def test_garbled_frame(spark):
    rows = [(i, SENTENCES[i % 7], 1) for i in range(70)] + [(100, mojibake.misread(SENTENCES[0], "utf_8", "cp1252"), 1), (101, None, 1), (102, "", 1), (103, "   ", 1), (104, "café " * 200_000, 1), (104, mojibake.misread("café " * 50_000, "utf_8", "cp1252"), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, garbled int")
    out = mojibake.find_garbled(df, "doc_id", "text", restore=True).collect()
    got = {r["doc_id"]: r["restored"] for r in out}
    assert set(got) == {100, 104} and got[100] == SENTENCES[0] and got[104] == "café " * 50_000
    assert mojibake.find_garbled(df.limit(0), "doc_id", "text").collect() == []


def test_the_dictionary_holds_every_word_of_three_documents(spark):
    words = ["é" + "".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(7000)]
    rows = [(i, " ".join(words)) for i in range(3)] + [(3, " ".join(words[:5])), (4, "żółw twice"), (5, "żółw twice")]
    counts = mojibake.corpus_counts(spark.createDataFrame(rows, "doc_id long, text string"), "text")[1]
    assert counts == {w: 4 if i < 5 else 3 for i, w in enumerate(words)}


@pytest.mark.parametrize("read", ["cp1252", "mac_roman", "cp1251"])
def test_garbled_stretch_within_text_without_blanks(finder, read):
    bad = "".join(mojibake.misread(c, "utf_8", read) for c in "東川橋")
    for before, after in (("区域から到達できる", "の住民は理由を尋ねた。"), ("住民は理由を尋ねた。", ""), ("", "から到達できる職場は増える。")):
        finder_ = mojibake.Finder(list("東川橋を"), {})
        assert finder_.garbled(before + bad + after) == 9 and finder_.restore(before + bad + after) == before + "東川橋" + after
    one = mojibake.misread("を", "utf_8", read)
    assert finder.garbled("住民は理由" + one + "尋ねた。") == 3 and finder.restore("住民は理由" + one + "尋ねた。") == "住民は理由を尋ねた。"
    russian = "Жители—" + mojibake.misread("почему", "utf_8", "cp1252") + "—перекрёстке"
    assert finder.restore(russian) == "Жители—почему—перекрёстке"


@pytest.mark.parametrize("read", ["cp1252", "latin_1", "mac_roman", "cp437", "cp1250"])
def test_utf8_misread_needs_no_corpus(read):
    """Alphabets the corpus does not hold: chains of one script, and Latin letters by themselves."""
    empty = mojibake.Finder([], {})
    for s in (SENTENCES[5], SENTENCES[4], SENTENCES[7], "Şu yağışlı İstanbul gecesinde ışık göründü.", "שלום לכל העולם", "안녕하세요 여러분", "สวัสดีชาวโลก"):
        bad = mojibake.misread(s, "utf_8", read)
        good = empty.restore(bad)
        assert empty.garbled(bad) >= 3 and good == s, (read, s, good)
        assert empty.garbled(s) == 0


def test_utf8_read_in_wide_encodings():
    empty = mojibake.Finder([], {})
    s = "住民は理由を尋ねた。区域から到達できる"
    for read in mojibake.WIDE:
        bad = mojibake.misread(s, "utf_8", read)
        assert empty.garbled(bad) >= 3
        if read != "big5":  # which has no character for most of the bytes: they are lost
            assert sum(c in s for c in empty.restore(bad)) >= 0.5 * len(s)
    for proper in ("== 水車小路 ==", s, "全角ＡＢＣ１２３", "ﾊﾝｶｸ カナ"):
        assert empty.garbled(proper) == 0


def test_proper_words_are_no_sequences(finder):
    """Words of other scripts whose letters some encoding reads bytes as, within the corpus's characters and beyond."""
    empty = mojibake.Finder([], {})
    for s in ("ещё её всё моё ребёнок", "СТАНЦИЯ ТЕХНИКА ТА УЧЕБНЫЕ", "Дійсно її Ві", "ΔΊΚΗ ΕΊΝΑΙ", "KÓŁKO ŻÓŁĆ", "раб стена тек ночь", "ПОЧТОВЫЕ ящики", "ÄÖÜ ÅÄÖ", "ÇOK ĞÜZEL ŞİMDİ"):
        assert empty.garbled(s) < 3 and empty.restore(s) == s, s
        assert finder.garbled(s) < 3, s


def test_rare_words_of_a_big_dictionary(spark):
    """A word beyond the most frequent thousands is found in its garbled form, by the distributed dictionary."""
    words = ["é" + "".join(chr(97 + i // 26**k % 26) for k in range(3)) + "ô" for i in range(7000)]
    rows = [(i, " ".join(words)) for i in range(3)] + [(i, " ".join(words[:6999])) for i in range(3, 9)]
    rows += [(100, " ".join(f"({mojibake.misread(words[-1], 'cp1252', 'mac_roman')}),-x" for _ in range(4))), (101, words[-1] + "."), (None, "le r�seau � ét�"), (102, "d’été ‘x’")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: (r["garbled"], r["restored"]) for r in mojibake.find_garbled(df, "doc_id", "text", restore=True).collect()}
    assert set(out) == {100, None} and out[100] == (8, " ".join([f"({words[-1]}),-x"] * 4)) and out[None][0] == 3
    model = mojibake.corpus_counts(df, "text")
    again = {r["doc_id"]: r["garbled"] for r in mojibake.find_garbled(df, "doc_id", "text", model=model).collect()}
    assert again == {k: v[0] for k, v in out.items()}
