import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from thicket.llm import op2_quality as op


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def texts():
    rng = random.Random(5)
    out = [None, "", " \t\n", "a", "a b c d e a b c d e", "x\nx\n \n \nx", "x\n x\nx ", "é# ß*|\x1fq\n" * 7, "one two three four five six seven " * 40]
    for _ in range(60):
        out.append("".join(rng.choice(["a", "b", " ", "\n", "\t", "#", "é", "\r", "!", "A"]) for _ in range(rng.randint(0, 200))))
    return out + ["word " * 50_000]


def test_counts_match_brute_force():
    t = op.Texts(pa.array(texts()))
    got = np.stack([t[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], axis=1)
    assert got.tolist() == [list(slow(x)) for x in texts()]


def test_query_over_nulls_repeats_and_order_of_rules(spark):
    rows = [(i, t, "z") for i, t in enumerate(texts())] + [(None, "a b", None), (0, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept2 string")
    got = Counter(map(tuple, op.judge(df, keep=["doc_id"]).collect()))
    want = Counter()
    everyone = op.Texts(pa.array([t for _, t, _ in rows]))
    passes = np.ones(len(rows), bool)
    for rule in reversed(op.RULES):
        passes &= ~rule.fails(everyone)
    for (i, t, _), ok in zip(rows, passes, strict=True):
        s = slow(t)
        failed = s[0] < 10 or 100 * s[4] > 20 * s[0]
        want[(i, *s, failed, bool(ok and not failed))] += 1
    assert got == want


def test_empty(spark):
    assert op.judge(spark.createDataFrame([], "doc_id long, text string"), keep=["doc_id"]).collect() == []


def test_the_cheap_and_strict_rule_comes_first(spark):
    df = spark.createDataFrame([(i, "plain words that go on for a while here, past the base test") for i in range(50)], "doc_id long, text string")
    rules = (op.Rule("never", lambda t: t["n_words"] < 0), op.Rule("always", lambda t: t["n_words"] > 0))
    assert [r[0] for r in op.plan(df, "text", rules)] == ["always", "never"]


def test_windows_whose_hashes_agree_are_still_told_apart(monkeypatch):
    class Same:
        def integers(self, *_, **__):
            return np.zeros(6, np.uint64)

    text = " ".join(f"w{i % 40}" for i in range(100)) + " " + " ".join(f"x{i}" for i in range(50))
    words, doc = pa.array(text.split()), np.zeros(150, np.uint64)
    want = op.repeated(words, doc)
    monkeypatch.setattr(op.np.random, "default_rng", lambda *_: Same())
    monkeypatch.setattr(op, "repeated", op.repeated)
    assert want.sum() == 100 and op.repeated(words, doc).tolist() == want.tolist()


def test_costs_leave_out_what_the_base_has_made(spark):
    rng = random.Random(2)
    long = [" ".join(f"word{rng.randint(0, 10**6)}" for _ in range(3000)) + "!" for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(["a b", None, *long])), "doc_id long, text string").coalesce(1)
    cost = {k: (s, share) for k, s, share in op.plan(df, "text")}
    # lines are counted before the cascade, letters are not; the base's own rejections are not the rules'
    assert cost["dup_lines"][0] * 5 < cost["letters"][0] and all(share == 0 for _, share in cost.values())


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b", True, "x")], "doc_id long, text string, Kept boolean, _text string")
    got = op.judge(df, keep=df.columns)
    assert got.columns == ["doc_id", "text", "_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"] and got.first()[:4] == (1, "a b", "x", 2)
