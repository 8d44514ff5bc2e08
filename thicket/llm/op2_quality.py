"""Quality rules as a short-circuit cascade, ordered by rejection per cost as measured on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import slices, small_batches, spare, split_words, sum_by, table, text_bytes, without

SYMBOLS = b"#*$%&|<>"
LETTER = np.array([chr(b).isalpha() or b >= 128 for b in range(256)])
CAPITAL = np.array([65 <= b <= 90 for b in range(256)])
SMALL = np.array([97 <= b <= 122 for b in range(256)])


class Texts:
    """Texts with features that are computed when a rule first asks for them; take() keeps those already there."""

    def __init__(self, texts: pa.Array, made: dict | None = None):
        self.texts, self._made = pc.fill_null(texts, ""), made or {}

    def take(self, keep: np.ndarray) -> Texts:
        return Texts(self.texts.take(pa.array(keep)), {k: v[keep] for k, v in self._made.items()})

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._made:
            self._made |= getattr(self, f"_{self.MAKERS[name]}")()
        return self._made[name]

    MAKERS = {
        "n_words": "count_words", "word_chars": "count_words", "n_repeat_words": "count_words", "n_symbols": "count_symbols", "n_capitals": "count_cases",
        "n_small": "count_cases", "n_exclaim": "count_exclaims", "n_lines": "count_lines", "n_dup_lines": "count_lines", "n_letter_words": "count_letter_words",
    }

    def _count_words(self) -> dict:
        offsets, words = split_words(self.texts)
        doc = np.repeat(np.arange(len(self.texts), dtype=np.uint64), np.diff(offsets))
        chars = sum_by(pc.utf8_length(words).to_numpy().astype(np.int64), offsets)
        return {"n_words": np.diff(offsets), "word_chars": chars, "n_repeat_words": sum_by(repeated(words, doc), offsets)}

    def _count_bytes(self, **kinds: np.ndarray) -> dict:
        offsets, data = text_bytes(self.texts)
        return {name: sum_by(kind[data], offsets) for name, kind in kinds.items()}

    def _count_symbols(self) -> dict:
        return self._count_bytes(n_symbols=np.isin(np.arange(256), list(SYMBOLS)))

    def _count_cases(self) -> dict:
        return self._count_bytes(n_capitals=CAPITAL, n_small=SMALL)

    def _count_exclaims(self) -> dict:
        return self._count_bytes(n_exclaim=np.arange(256) == 33)

    def _count_lines(self) -> dict:
        lists = pc.split_pattern(self.texts, "\n")
        flat, offsets = lists.values, np.asarray(lists.offsets).astype(np.int64)
        doc = np.repeat(np.arange(len(self.texts), dtype=np.int64), np.diff(offsets))
        full = pc.binary_length(pc.ascii_trim_whitespace(flat)).to_numpy() > 0
        line, doc = flat.filter(pa.array(full)).dictionary_encode().indices.to_numpy().astype(np.int64), doc[full]
        n = np.bincount(doc, minlength=len(self.texts))
        kinds = np.bincount(np.unique(doc << 32 | line) >> 32, minlength=len(self.texts))
        return {"n_lines": n, "n_dup_lines": n - kinds}

    def _count_letter_words(self) -> dict:
        offsets, words = split_words(self.texts)
        starts, data = text_bytes(words)
        return {"n_letter_words": sum_by(sum_by(LETTER[data], starts) > 0, offsets)}


def repeated(words: pa.Array, doc: np.ndarray, width: int = 5) -> np.ndarray:
    """1 for each word that lies in a window of so many words that its text holds twice or more.

    Windows are grouped by a 64-bit hash of the words' numbers in this batch, and each is held against its group's first, word
    by word; should one differ, all are grouped by their words.
    """
    covered = np.zeros(len(words), np.int64)
    n = len(words) - width + 1
    if n < 1:
        return covered
    ids = words.dictionary_encode().indices.to_numpy().astype(np.uint64) + np.uint64(1)
    factors = np.random.default_rng(7).integers(1, 2**63, width + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    key = doc[:n] * factors[width]
    for i in range(width):
        key = key + ids[i : i + n] * factors[i] * (ids[i : i + n] ^ factors[i])
    whole = doc[:n] == doc[width - 1 :]
    which = pa.array(key[whole]).dictionary_encode().indices.to_numpy()
    at = np.flatnonzero(whole)
    first = at[np.unique(which, return_index=True)[1]]
    if not all((x[at] == x[first[which]]).all() for x in (doc, *(ids[i:] for i in range(width)))):
        which = np.unique(np.stack([doc[at], *(ids[at + i] for i in range(width))]), axis=1, return_inverse=True)[1].ravel()
    twice = np.zeros(n, bool)
    twice[whole] = np.bincount(which)[which] > 1 if len(which) else False
    for i in range(width):
        covered[i : i + n] |= twice
    return covered


@dataclass(frozen=True)
class Rule:
    """name, and a function of Texts that tells which texts fail."""

    name: str
    fails: Callable[[Texts], np.ndarray] = field(compare=False)


#: The base counts come first in op2's contract; these are the method's own rules. Thresholds are shares of words or lines.
RULES: tuple[Rule, ...] = (
    Rule("symbols", lambda t: t["n_symbols"] > 0.1 * t["n_words"]),
    Rule("exclamation", lambda t: t["n_exclaim"] > 0.3 * t["n_words"]),
    Rule("capitals", lambda t: t["n_capitals"] > 0.6 * np.maximum(t["n_capitals"] + t["n_small"], 20)),
    Rule("word_length", lambda t: (t["word_chars"] < 2 * t["n_words"]) | (t["word_chars"] > 14 * t["n_words"])),
    Rule("letters", lambda t: t["n_letter_words"] < 0.7 * t["n_words"]),
    Rule("dup_lines", lambda t: t["n_dup_lines"] > 0.3 * t["n_lines"]),
)


def base_fails(t: Texts) -> np.ndarray:
    return (t["n_words"] < 10) | (100 * t["n_repeat_words"] > 20 * t["n_words"])


def cascade(texts: Texts, rules: Sequence[Rule], alive: np.ndarray) -> np.ndarray:
    """Which of the alive texts pass all rules; each rule looks only at those that the rules before it let through."""
    rows = np.flatnonzero(alive)
    rest = texts.take(rows)
    for rule in rules:
        if not len(rows):
            break
        passed = np.flatnonzero(~rule.fails(rest))
        if len(passed) < len(rows):
            rows, rest = rows[passed], rest.take(passed)
    kept = np.zeros(len(texts.texts), bool)
    kept[rows] = True
    return kept


#: made for every text before the cascade, as results
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def plan(df: DataFrame, text: str, rules: Sequence[Rule] = RULES, sample_rows: int = 512, base: Callable[[Texts], np.ndarray] = base_fails) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected), best rejection per cost first.

    Measured on about sample_rows rows drawn at random, on those that pass the base test: a rule costs what it adds to the
    counts that are there by then, and rejects what the base lets through. Only the order of the rules depends on it, and
    since a text is kept if it passes all of them, no result does. An empty sample leaves the rules as they are.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            everything = Texts(batch.column("_text"))
            for k in COUNTS:
                everything[k]
            passed = everything.take(np.flatnonzero(~base(everything)))
            for i, rule in enumerate(rules):
                texts = Texts(passed.texts, dict(passed._made))
                began = time.perf_counter()
                failed = int(rule.fails(texts).sum())
                yield pa.RecordBatch.from_pydict({"rule": pa.array([i], pa.int32()), "s": [time.perf_counter() - began], "failed": [failed], "n": [len(passed.texts)]})

    rows = df.select(F.col(text).alias("_text"))
    share = min(1.0, sample_rows / max(1, rows.count()))
    sample = rows.sample(fraction=share, seed=11) if share < 1 else rows
    got = sample.mapInArrow(measure, "rule int, s double, failed long, n long").groupBy("rule").agg(F.sum("s"), F.sum("failed"), F.sum("n")).collect()
    cost = {rules[i].name: (s / n, failed / n) for i, s, failed, n in got if n}
    order = sorted((r.name for r in rules), key=lambda k: -cost[k][1] / max(cost[k][0], 1e-9) if k in cost else 0)
    return [(k, *cost.get(k, (0.0, 0.0))) for k in order]


def judge(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, keep: Sequence[str] = (), base: Callable[[Texts], np.ndarray] = base_fails, sample_rows: int = 512) -> DataFrame:
    """The columns `keep` of df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    A null or empty text has no words and fails the base test. Whole texts count, however long; repeated rows stay, and so
    does an empty table's schema. Columns of df other than those in `keep` and the text are not read; a column with the
    name of a result is replaced.
    """
    order = {name: i for i, (name, _, _) in enumerate(plan(df, text, rules, sample_rows, base))}
    ordered = sorted(rules, key=lambda r: order[r.name])
    counts = COUNTS
    keep = without(keep, (*counts, "base_failed", "kept"))
    text_ = spare(df.columns, "_text")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_):
            texts = Texts(batch.column(text_))
            columns = [pa.array(texts[k].astype(np.int64)) for k in counts]
            failed = base(texts)
            columns += [pa.array(failed), pa.array(cascade(texts, ordered, ~failed))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *columns], [*keep, *counts, "base_failed", "kept"])

    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep]
    schema = ", ".join([*kinds, *(f"{k} long" for k in counts), "base_failed boolean", "kept boolean"])
    return df.select(*keep, F.col(text).alias(text_)).mapInArrow(run, schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, the five counts, base_failed, kept) of every document; see judge for odd rows."""
    small_batches(spark)
    return judge(table(spark, sf_dir, "documents"), keep=["doc_id"])


#: the same counts and rules; which rule rejects does not depend on the cascade's order
ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), gram AS (
  SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM t WHERE len(ws) >= 5
), twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i : i + 4], ' ')) AS n FROM gram
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 5) r(k) WHERE n > 1 GROUP BY doc_id
), counted AS (
  SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines, coalesce(covered.n, 0) AS n_repeat_words,
    len(regexp_extract_all(t, '!')) AS exclaim, len(regexp_extract_all(t, '[A-Z]')) AS big, len(regexp_extract_all(t, '[a-z]')) AS small, len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS letter_words
  FROM t LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > 1e-1 * n_words OR exclaim > 3e-1 * n_words OR big > 6e-1 * greatest(big + small, 20) OR word_chars < 2 * n_words OR word_chars > 14 * n_words
    OR letter_words < 7e-1 * n_words OR n_dup_lines > 3e-1 * len(full_lines)) AS kept
FROM judged
"""
