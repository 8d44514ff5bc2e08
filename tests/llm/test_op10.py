import random

import pytest

from thicket.llm import op10_language as op


def longest(text, at, sample):
    n = 0
    while at + n < len(text) and text[at : at + n + 1] in sample:
        n += 1
    return n


def test_automaton_finds_longest_matches():
    rng = random.Random(0)
    sample = [rng.randint(0, 3) for _ in range(300)]
    table = op.Automaton(sample, 5).table
    text = "".join(map(str, sample))
    for _ in range(200):
        q = [rng.randint(0, 4) for _ in range(12)]
        state, n = 0, 0
        for s in q:
            if table[state, s] < 0:
                break
            state, n = table[state, s], n + 1
        assert n == longest("".join(map(str, q)), 0, text)


SCRIPTS = {"el": ("αβγδεζηθικλμνξοπρστυφχψω", 1), "en": ("abcdefghijklmnopqrstuvwxyz", 2), "ja": ("".join(map(chr, range(0x3041, 0x3097))) + "".join(map(chr, range(0x5000, 0x5300))), 3), "ko": ("".join(map(chr, range(0xAC00, 0xAE00))), 4), "zh": ("".join(map(chr, range(0x5100, 0x5600))), 5)}


def babble(lang, n, seed):
    """Words from a small vocabulary of the script's letters."""
    letters, own = SCRIPTS[lang]
    rng = random.Random(own)
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(300)]
    rng = random.Random(seed)
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.mark.parametrize("samples", [
    {"aa": "the quick brown fox jumps over the lazy dog " * 3, "bb": "el zorro salta sobre el perro perezoso " * 3},
    {k: babble(k, 700, 0) for k in SCRIPTS},
])
def test_phrases_are_those_of_whole_texts(samples):
    model = op.Model(samples)
    rng = random.Random(3)
    texts = ["the brown dog", "EL PERRO!!! salta", "zzz qqq", "", "fox " * 400, "ç1-2ß", "a" * 1000, " ".join(rng.choice(["over", "the", "sobre", "perro", "lazy dog"]) for _ in range(300))]
    texts += [babble(k, 120, 1) for k in SCRIPTS] + [next(iter(samples.values())) * 4]
    got, n = model.phrases(texts)
    for row, k in zip(got, model.languages, strict=True):
        sample = "".join(chr(c + 1) for c in model.symbols(samples[k]))
        for j, t in enumerate(texts):
            s = "".join(chr(c + 1) for c in model.symbols(t))
            want, at = 0, 0
            while at < len(s):
                at += max(1, longest(s, at, sample))
                want += 1
            assert (row[j], n[j]) == (want, len(s)), (k, t)


def test_no_letter_of_a_sample_is_taken_for_another():
    samples = {k: babble(k, 3000, 0) for k in SCRIPTS}
    model = op.Model(samples)
    letters = sorted({c for t in samples.values() for c in t if c.isalpha()})
    assert len(letters) > 1000 and len({tuple(model.symbols(c).tolist()) for c in letters}) == len(letters)
    for k in SCRIPTS:
        found, _ = model.predict([babble(k, 20, s) for s in range(50)])
        assert found == [k] * 50


def test_letters_and_ties():
    names, scores = op.Model({"bb": "abc abd", "aa": "abc abd"}).predict(["abc", "½", "² Ⅷ", "١٢", "_", "é", "ª"])
    assert names == ["aa", "und", "und", "und", "und", "aa", "aa"] and scores.tolist() == [0.0] * 7


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "the thing", "x", "y", 5)], "doc_id long, text string, lang_pred string, _text string, SCORE int")
    got = op.identify(df, (("en", "the thing"),), df.columns)
    assert got.columns == ["doc_id", "text", "_text", "lang_pred", "score"] and got.first()[:4] == (1, "the thing", "y", "en")


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(1)
    words = {"en": "the and thing ing tion er ed", "fr": "le la eau ment que aux é", "de": "der und heit ung ß schaft"}
    rows = []
    for i in range(150):
        k = rng.choice(sorted(words))
        rows.append((i, " ".join(rng.choice(words[k].split()) + rng.choice(words[k].split()) for _ in range(60)), k))
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 ### !!", "en"), (None, "the and thing", None), (1, rows[1][1], rows[1][2]), (2000, "the thing " * 60_000, "en")]
    df = spark.createDataFrame([(*r, 0) for r in rows + odd], "doc_id long, text string, lang string, chars int")
    samples = op.learn(df.where("doc_id % 5 <> 0"))
    assert [k for k, _ in samples] == ["de", "en", "fr"] and all(len(t) <= 40_000 for _, t in samples)
    got = {r.doc_id: r for r in op.identify(df.select("doc_id", "text"), samples, ["doc_id"]).collect()}
    assert sum(got[i].lang_pred == k for i, _, k in rows) >= 147
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and got[2000].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert op.identify(df.limit(0).select("doc_id", "text"), samples, ["doc_id"]).count() == 0
    assert {r.lang_pred for r in op.identify(df.select("doc_id", "text"), (), ["doc_id"]).collect()} == {"und"}


@pytest.mark.parametrize("samples", [{"aa": ""}, {"aa": "abc"}])
def test_tiny_samples(samples):
    names, scores = op.Model(samples).predict(["abc", None])
    assert names == ["aa", "und"] and scores[0] == 1
