"""Language ID by cross-parsing entropy.

A suffix automaton of labelled text per language knows all substrings of it. A text is parsed greedily into the longest
phrases that an automaton knows; the language that needs the fewest phrases for a symbol wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.llm.common import crc_fold, slices, small_batches, spare, table, without

UNKNOWN = "und"
PLAIN = re.compile("[A-Za-z]")
LANE = 128
_built: dict = {}


def has_letter(text: str) -> bool:
    """A character of Unicode's letter categories; numerals of letter-like shape are none."""
    return PLAIN.search(text) is not None or any(map(str.isalpha, text))


class Automaton:
    """Suffix automaton over symbols 0 .. width-1 as a dense table; -1: no such substring."""

    def __init__(self, symbols: list[int], width: int):
        following, link, length = [[-1] * width], [-1], [0]
        last = 0
        for s in symbols:
            new = len(following)
            following.append([-1] * width)
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and following[p][s] == -1:
                following[p][s] = new
                p = link[p]
            if p != -1:
                q = following[p][s]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(following)
                    following.append(following[q][:])
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and following[p][s] == q:
                        following[p][s] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.table = np.array(following, np.int32)


class Model:
    """Automata of the sample texts of each language.

    Symbols: one for each run of other characters than letters (a separator), one for letters that no sample shows, a pad,
    and the letters of the samples, lower-cased. If the samples have more letters than a table of `width` symbols has room
    for, the most frequent keep a symbol each, and every other becomes a code of `size` digits, which are symbols of their
    own: a prefix-free code, so that no letter is taken for another and tables stay `width` wide for any script.
    """

    DIGITS = 16

    def __init__(self, samples: dict[str, str], width: int = 64):
        self.languages = sorted(samples)
        counts: dict[str, int] = {}
        for text in samples.values():
            for c in text.lower():
                if c.isalpha():
                    counts[c] = counts.get(c, 0) + 1
        letters = sorted(counts, key=lambda c: (-counts[c], c))
        self.separator, self.other, self.pad = 0, 1, width - 1
        single = len(letters) if len(letters) <= width - 3 else width - 3 - self.DIGITS
        rest = letters[single:]
        self.size = 1
        while self.DIGITS**self.size < len(rest):
            self.size += 1
        #: a character's symbol; from `width` on, the number of a letter that has a code
        self.codes = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            if chr(c).isalpha():
                self.codes[c] = self.other
        for i, c in enumerate(letters[:single]):
            self.codes[ord(c)] = i + 2
        self.width = width
        for i, c in enumerate(rest):
            self.codes[ord(c)] = width + i
        first = width - 1 - self.DIGITS
        places = self.DIGITS ** np.arange(self.size)[::-1]
        self.spelled = (np.arange(max(len(rest), 1))[:, None] // places % self.DIGITS + first).astype(np.uint8)
        self.tables = []
        for k in self.languages:
            t = Automaton(self.symbols(samples[k]).tolist(), width).table
            # a symbol that the sample never shows is a phrase of its own, and at the root every symbol begins one
            start = np.where(t[0] >= 0, t[0], 0).astype(np.int32)
            step = np.where(t >= 0, t, start[None, :])
            new = t < 0
            new[0] = True
            step[:, self.pad], new[:, self.pad] = 0, False
            # one gather gives the next state and, in the lowest bit, whether a phrase began
            self.tables.append(((step.astype(np.int32) * width) << 1 | new).astype(np.int32).ravel())

    def symbols(self, text: str) -> np.ndarray:
        """The text's symbols without repeated separators."""
        s = self.codes[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        s = s[np.concatenate([[True], (s[1:] != self.separator) | (s[:-1] != self.separator)])] if len(s) else s
        coded = s >= self.width
        if not coded.any():
            return s.astype(np.uint8)
        times = np.where(coded, self.size, 1)
        out = np.repeat(s, times).astype(np.uint8)
        at = (np.cumsum(times) - times)[coded]
        for j in range(self.size):
            out[at + j] = self.spelled[s[coded] - self.width, j]
        return out

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases [language, text], symbols by text), each text parsed as one sequence.

        Texts are cut in lanes of LANE symbols and all lanes are parsed in step, as if each began a phrase. Then each lane
        whose text began before it is parsed again from the state in which the lane before it ends, up to the symbol where
        both parses are in one state, from which on they agree; if that changes the lane's own end, the next lane follows.
        """
        parts = [self.symbols(t) for t in texts]
        n = np.array([len(p) for p in parts], np.int64)
        lanes = -(-n // LANE)
        flat = np.full(lanes.sum() * LANE, self.pad, np.uint8)
        at = np.concatenate([[0], np.cumsum(lanes)]) * LANE
        for p, k in zip(parts, at[:-1].tolist(), strict=True):
            flat[k : k + len(p)] = p
        by_step = np.ascontiguousarray(flat.reshape(-1, LANE).T).astype(np.int32)
        owner = np.repeat(np.arange(len(texts)), lanes)
        follows = np.concatenate([[False], owner[1:] == owner[:-1]]) if len(owner) else np.zeros(0, bool)
        made = np.zeros((len(self.tables), len(texts)), np.int64)
        got = np.empty(by_step.shape, np.int32)
        for i, t in enumerate(self.tables):
            state, count = np.zeros(by_step.shape[1], np.int32), np.zeros(by_step.shape[1], np.int32)
            for symbol, row in zip(by_step, got, strict=True):
                t.take(state + symbol, out=row)
                state = row >> 1
                count += row & 1
            entry = np.zeros(len(owner), np.int32)
            todo = np.flatnonzero(follows)
            while len(todo):
                ends = got[-1, todo - 1] >> 1
                moved = entry[todo] != ends
                now, state = todo[moved], ends[moved]
                entry[now] = state
                for symbol, row in zip(by_step, got, strict=True):
                    if not len(now):
                        break
                    new, old = t[state + symbol[now]], row[now]
                    row[now] = new
                    count[now] += (new & 1) - (old & 1)
                    apart = new >> 1 != old >> 1
                    now, state = now[apart], new[apart] >> 1
                # what still differs at its end changes where the next lane of its text begins
                todo = now[now < len(owner) - 1] + 1
                todo = todo[follows[todo]]
            made[i] = np.bincount(owner, count, len(texts)).astype(np.int64) if len(owner) else 0
        return made, n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(languages, scores). `und` with score 0 for null texts and those without a letter, and if nothing was learned.

        The score is the share of phrases that the winner saves against the second best, at most 1, and 1 if there is only one language.
        """
        known = [t if t is not None and self.languages and has_letter(t) else "" for t in texts]
        counts, n = self.phrases(known)
        named = np.array([bool(t) for t in known])
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        rate = counts / np.maximum(n, 1)
        best = rate.argmin(axis=0)
        two = np.sort(rate, axis=0)[:2]
        score = np.where(two[1] > 0, 1 - two[0] / np.maximum(two[1], 1e-12), 0.0) if len(two) > 1 else np.ones(len(texts))
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, named, strict=True)], np.where(named, score, 0.0)


def model_of(samples: tuple[tuple[str, str], ...]) -> Model:
    """Built once in each Python worker."""
    if samples not in _built:
        _built.clear()
        _built[samples] = Model(dict(samples))
    return _built[samples]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs: int = 48, chars: int = 40_000) -> tuple[tuple[str, str], ...]:
    """(language, sample text) pairs: the bounded sample that the automata are built from.

    For each non-null label up to `docs` documents that have a letter, by the smallest hash of the key, those of at most
    `chars` / 8 characters first; joined and cut at `chars` characters. These bounds are the fit's only limits. Null texts
    and labels are left out; a language without a letter in any text is not learned.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit(5), key).alias("h")).where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    order = Window.partitionBy("lang").orderBy(F.length("text") > chars // 8, "h", "text")
    ranked = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= docs).withColumn("text", F.substring("text", 1, chars))
    got: dict[str, list] = {}
    for k, t, r in ranked.select("lang", "text", "r").collect():
        got.setdefault(k, []).append((r, t))
    return tuple((k, " ".join(t for _, t in sorted(v))[:chars]) for k, v in sorted(got.items()))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], keep: list[str], text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of docs with the language and score under `names`, which replace columns of those names; only the text decides.

    Whole texts are parsed; repeated rows stay; ties go to the first language by code point. A null or empty text, or one
    without a letter, is `und` with score 0, and so is every text if nothing was learned. No rows: no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(samples)  # at most `chars` characters a language
    keep = without(keep, names)
    column = text if text in keep else spare([*keep, *names], "_text")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shipped.value)
        for batch in slices(batches, column, 4 << 20):
            found, scores = model.predict(batch.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(found, pa.string()), pa.array(scores)], [*keep, *names])

    kinds = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep]
    rows = docs.select(*keep) if column == text else docs.select(*keep, F.col(text).alias(column))
    return rows.mapInArrow(run, ", ".join([*kinds, f"`{names[0]}` string", f"`{names[1]}` double"]))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learned from those not held out; see learn and identify for odd rows."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = crc_fold("doc_id", 5)
    samples = learn(docs.where(fold != 0))
    out = identify(docs.select("doc_id", "text", F.coalesce(fold == 0, F.lit(False)).alias("held_out")), samples, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")
