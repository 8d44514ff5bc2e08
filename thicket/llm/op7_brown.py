"""LM scoring by Brown's class-based bigrams.

A word has a class; P(word | word before) = P(class | class before) * P(word | class). Exchange clustering moves words from
class to class while the likelihood of the training text's class bigrams rises, in two stages: on the driver the units of a
table of fixed size (the most frequent words, and all others by their ending), one move at a time; then in distributed
rounds every word that stands `least` times or more, all at once, each by the classes of its own neighbours in all training
text. So the clustered vocabulary grows with the corpus; only words rarer than that, and words never seen, have the class of
their ending. Word counts stay a distributed table, keyed by a 64-bit hash of the word; its frequent part, of bounded size,
is broadcast with the classes, and rarer words meet the table in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import crc_fold, slices, small_batches, spare, split_words, stored, sum_by, table, text_bytes, without

#: the hash that stands for the end of a text; no word can hold a space
END_HASH = int(np.uint64(xxhash.xxh64_intdigest(b" end ")).astype(np.int64))
ALPHA = 0.5


def hash_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(each word's place among the different words, their hashes as signed 64 bits, the words)."""
    d = words.dictionary_encode()
    known = []
    if len(d.dictionary):
        at, data = text_bytes(d.dictionary)
        raw, at = data.tobytes(), at.tolist()
        known = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, count=len(known)).view(np.int64)
    return d.indices.to_numpy().astype(np.int64), hashes, known


def ending(known: list[bytes], endings: int) -> np.ndarray:
    """The group of each word's last three bytes."""
    h = xxhash.xxh32_intdigest
    return np.fromiter((h(w[-3:]) % endings for w in known), np.int64, count=len(known))


@dataclass
class Units:
    """The units: `heads` sorted hashes of the words that are one, then `endings` groups of the other words by their last three bytes, then the end."""

    heads: np.ndarray
    endings: int

    @property
    def n(self) -> int:
        return len(self.heads) + self.endings + 1

    def of(self, hashes: np.ndarray, known: list[bytes]) -> np.ndarray:
        at = np.searchsorted(self.heads, hashes)
        is_head = self.heads[np.minimum(at, max(len(self.heads) - 1, 0))] == hashes if len(self.heads) else np.zeros(len(hashes), bool)
        rest = np.flatnonzero(~is_head)
        at[rest] = len(self.heads) + ending([known[i] for i in rest.tolist()], self.endings)
        return at


def sequence(units_of_words: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit before, unit) of each token, a text's end included; before its first word stands an end."""
    n = np.diff(offsets)
    at = offsets + np.arange(len(offsets))
    now = np.full(len(units_of_words) + len(n), end, np.int64)
    where = np.arange(len(units_of_words)) + np.repeat(np.arange(len(n)), n)
    now[where] = units_of_words
    before = np.concatenate([[end], now[:-1]])
    before[at[:-1]] = end
    return before, now


def count_words(train: DataFrame, text: str, endings: int) -> DataFrame:
    """(h, c, e): how often the word with hash h stands in the texts, and its ending's group; each text adds one end, with e null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            _, words = split_words(batch.column("_text"), lower=True)
            ids, hashes, known = hash_words(words)
            n = np.bincount(ids, minlength=len(hashes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(n), pa.array(ending(known, endings).astype(np.int32))], ["h", "c", "e"])
            yield pa.RecordBatch.from_arrays([pa.array([END_HASH]), pa.array([batch.num_rows]), pa.array([None], pa.int32())], ["h", "c", "e"])

    made = train.select(F.col(text).alias("_text")).mapInArrow(run, "h long, c long, e int")
    return made.groupBy("h").agg(F.sum("c").alias("c"), F.max("e").alias("e"))


def count_pairs(train: DataFrame, text: str, units: Units, label: np.ndarray, classes: int, contexts: bool = False) -> DataFrame:
    """(key, n). key >= 0: label key div classes is followed by label key mod classes n times in all texts.

    With contexts also key < 0, for the words units.heads: -1 - key = (2 * classes) * word + label of the word before, or that
    of the word after plus `classes`. A task adds up what it sees, in arrays of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(classes * classes, np.int64)
        keys, times = np.empty(0, np.int64), np.empty(0, np.int64)

        def sent(keys: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(keys), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 65536]), pa.array(times[k : k + 65536])], ["key", "n"])

        for batch in slices(batches, "_text"):
            offsets, words = split_words(batch.column("_text"), lower=True)
            ids, hashes, known = hash_words(words)
            unit = units.of(hashes, known)
            before, now = sequence(label[unit][ids], offsets, label[-1])
            n += np.bincount(before * classes + now, minlength=len(n))
            if contexts and len(ids):
                place = np.arange(len(ids)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                both = np.concatenate([ids * (2 * classes) + before[place], ids * (2 * classes) + classes + now[place + 1]])
                seen = np.bincount(both, minlength=len(hashes) * 2 * classes).reshape(-1, 2 * classes)
                mine = np.flatnonzero(unit < len(units.heads))
                word, code = np.nonzero(seen[mine])
                keys = np.concatenate([keys, unit[mine][word] * (2 * classes) + code])
                times = np.concatenate([times, seen[mine][word, code]])
                if len(keys) > 4_000_000:
                    keys, at = np.unique(keys, return_inverse=True)
                    times = np.bincount(at, times, len(keys)).astype(np.int64)
                    if len(keys) > 2_000_000:
                        yield from sent(-1 - keys, times)
                        keys, times = keys[:0], times[:0]
        if len(keys):
            keys, at = np.unique(keys, return_inverse=True)
            yield from sent(-1 - keys, np.bincount(at, times, len(keys)).astype(np.int64))
        seen = np.flatnonzero(n)
        yield from sent(seen, n[seen])

    return train.select(F.col(text).alias("_text")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def pair_matrix(counted: DataFrame, classes: int) -> np.ndarray:
    """[classes, classes] of the pairs of count_pairs: at most classes ** 2 rows go to the driver."""
    got = counted.where("key >= 0").toPandas()
    n = np.zeros(classes * classes)
    n[got["key"].to_numpy(np.int64)] = got["n"]
    return n.reshape(classes, classes)


def moved(counted: DataFrame, pair: np.ndarray, classes: int) -> DataFrame:
    """(word, label): the best class of each word by its contexts in count_pairs.

    Adding a word to class k raises the likelihood, to first order, by the logs of k's pairs with the classes of its neighbours, less
    those of k's totals: a word is small against its class. Ties go to the lowest class; the end's class is its own.
    """
    logs, size = np.log(pair + ALPHA), np.log(pair.sum(axis=1) + ALPHA) + np.log(pair.sum(axis=0) + ALPHA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 3), np.int64)

        def best(rows: np.ndarray) -> pa.RecordBatch:
            word, at = np.unique(rows[:, 0], return_inverse=True)
            seen = np.bincount(at * (2 * classes) + rows[:, 1], rows[:, 2], len(word) * 2 * classes).reshape(-1, 2, classes)
            gain = seen[:, 0] @ logs + seen[:, 1] @ logs.T - seen[:, 0].sum(axis=1)[:, None] * size
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(gain[:, : classes - 1].argmax(axis=1).astype(np.int16))], ["word", "label"])

        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)])
            # the last word may go on in the next batch
            whole = held[:, 0] < held[-1, 0] if len(held) else np.zeros(0, bool)
            if whole.any():
                yield best(held[whole])
                held = held[~whole]
        if len(held):
            yield best(held)

    code = -1 - F.col("key")
    asked = counted.where("key < 0").select(F.floor(code / (2 * classes)).cast("long").alias("word"), (code % (2 * classes)).alias("code"), "n")
    return asked.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word long, label short")


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(n: np.ndarray, classes: int, rounds: int = 8) -> np.ndarray:
    """The class of each unit, from n[a, b] bigram counts; the last unit, the end, keeps a class of its own.

    Units start in classes by frequency. Each in turn, most frequent first, moves to the class where the likelihood
    sum over class pairs of N log N, less that over classes of both sides, is greatest; ties to the lowest class. It ends
    when no unit moves, or after `rounds`.
    """
    units = len(n)
    size = n.sum(axis=0) + n.sum(axis=1)
    order = np.argsort(-size[:-1], kind="stable")
    label = np.empty(units, np.int64)
    label[order] = np.arange(units - 1) % (classes - 1)
    label[-1] = classes - 1
    # right[u, k]: u before class k; left[u, k]: class k before u
    hot = np.eye(classes)[label]
    right, left = n @ hot, n.T @ hot
    pair = hot.T @ right
    for _ in range(rounds):
        moved = 0
        for u in order:
            if not size[u]:
                continue
            old, r, c, own = label[u], right[u].copy(), left[u].copy(), n[u, u]
            r[old] -= own
            c[old] -= own
            base = pair.copy()
            base[old] -= r
            base[:, old] -= c
            base[old, old] -= own
            # the words before u still precede it, and those after it still follow, wherever it goes
            rows, cols = base.sum(axis=1) + c, base.sum(axis=0) + r
            free = classes - 1
            ks = np.arange(free)
            # adding u to k changes row k, column k and their crossing
            grown_rows = base[:free] + r
            gain = (xlogx(grown_rows) - xlogx(base[:free])).sum(axis=1)
            grown_cols = base[:, :free].T + c
            gain += (xlogx(grown_cols) - xlogx(base[:, :free].T)).sum(axis=1)
            cross = base[ks, ks]
            gain += xlogx(cross + r[:free] + c[:free] + own) + xlogx(cross) - xlogx(cross + r[:free]) - xlogx(cross + c[:free])
            gain -= xlogx(rows[:free] + r.sum() + own) - xlogx(rows[:free]) + xlogx(cols[:free] + c.sum() + own) - xlogx(cols[:free])
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            base[new] += r
            base[:, new] += c
            base[new, new] += own
            pair = base
            if new != old:
                moved += 1
                label[u] = new
                right[:, old] -= n[:, u]
                right[:, new] += n[:, u]
                left[:, old] -= n[u]
                left[:, new] += n[u]
        if not moved:
            break
    return label


@dataclass
class Brown:
    """A fitted model. words is a stored table (h, c); the arrays have bounded sizes."""

    words: DataFrame
    total: int
    distinct: int
    units: Units
    label: np.ndarray
    log_step: np.ndarray
    log_room: np.ndarray
    frequent: np.ndarray
    counts: np.ndarray


def fit(train: DataFrame, text: str = "text", seeds: int = 500, endings: int = 256, classes: int = 32, least: int = 3, rounds: int = 2, frequent: int = 1_000_000) -> Brown:
    """A model of all train texts (null: empty, of one end).

    seeds and endings set the size of the driver's clustering. Then every word that stands `least` times or more moves to its
    best class, `rounds` times. At most about `frequent` words are broadcast (17 bytes each), those of the greatest counts:
    where a corpus has more words than that, the count that a word needs to have a class of its own rises above `least`.
    """
    words = stored(count_words(train, text, endings))
    by_count = words.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c"))
    total, distinct = words.agg(F.sum("c"), F.count("*")).first()
    total, distinct = total or 0, distinct or 0
    held, lowest = 0, None
    for c, n in by_count.limit(frequent + 1).collect():
        if held + n > frequent:
            break
        held, lowest = held + n, c
    rows = words.where(F.col("c") >= lowest).toArrow() if lowest is not None else None
    hs, cs, es = (rows[k].combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for k in "hce") if rows is not None else (np.empty(0, np.int64) for _ in "hce")
    order = np.argsort(hs)
    hs, cs, es = hs[order], cs[order], es[order]

    top = np.lexsort((hs, -cs))
    first = np.sort(top[hs[top] != END_HASH][:seeds])  # places in hs, in its order
    units = Units(hs[first], endings)
    n = pair_matrix(count_pairs(train, text, units, np.arange(units.n), units.n), units.n)
    label = exchange(n, classes)

    own = np.flatnonzero(((cs >= least) | np.isin(hs, units.heads)) & (hs != END_HASH))
    whole = Units(hs[own], endings)
    fixed = np.isin(whole.heads, units.heads)
    start = label[len(units.heads) + es[own]]
    start[fixed] = label[: len(units.heads)]
    label = np.concatenate([start, label[len(units.heads) :]])
    for _ in range(rounds):
        counted = stored(count_pairs(train, text, whole, label, classes, contexts=True))
        got = moved(counted, pair_matrix(counted, classes), classes).toArrow()  # at most `frequent` rows
        new = label.copy()
        new[got["word"].to_numpy()] = got["label"].to_numpy()
        new[: len(fixed)][fixed] = label[: len(fixed)][fixed]
        if (new == label).all():
            break
        label = new
    pair = pair_matrix(count_pairs(train, text, whole, label, classes), classes)
    row, column = pair.sum(axis=1), pair.sum(axis=0)
    share = (column + ALPHA) / (column.sum() + ALPHA * classes)
    step = (pair + classes * share) / (row + classes)[:, None]
    # P(word | class) = (c + ALPHA) / (N + ALPHA * (words of the class + 1)); the end, alone in its class, is certain
    kinds = np.bincount(label[: len(own)], minlength=classes)
    mine = np.bincount(es[own], minlength=endings)
    for e, k in words.where(F.col("e").isNotNull()).groupBy("e").count().collect():
        kinds[label[len(own) + e]] += k - mine[e]
    room = column + ALPHA * (kinds + 1)
    return Brown(words, total, distinct, whole, label.astype(np.int16), np.log10(step), np.log10(np.maximum(room, ALPHA)), hs, cs)


def score(docs: DataFrame, model: Brown, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` with n_tokens, n_known, base_score and score.

    Every row of docs has its own result, repeated rows and null ids too; a null text is empty. Frequent words are looked
    up in the broadcast arrays; of the others each text sends a hash and a number to a join with the word table, and gets a
    sum back. Columns with the name of a result are replaced. No rows: no rows.
    """
    spark = docs.sparkSession
    keep = without(keep, ("n_tokens", "n_known", "base_score", "score"))
    inner = spare([*docs.columns, "n_tokens", "n_known", "base_score", "score"], "_row", "_known", "_logs", "_path", "_ends", "_h", "_n", "_text", "_more", "_found")
    row_, known_, logs_, path_, ends_, h_, n_, text_, more_, found_ = inner
    shipped = spark.sparkContext.broadcast((model.units, model.label, model.log_step, model.log_room, model.frequent, model.counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, label, log_step, log_room, frequent, counts = shipped.value
        row, pid = 0, TaskContext.get().partitionId()
        at_end = np.searchsorted(frequent, END_HASH)
        ends = int(counts[at_end]) if at_end < len(frequent) and frequent[at_end] == END_HASH else None
        for batch in slices(batches, text_):
            offsets, words = split_words(batch.column(text_), lower=True)
            ids, hashes, known = hash_words(words)
            m = np.diff(offsets)
            before, now = sequence(label[units.of(hashes, known)][ids], offsets, label[-1])
            # a word's emission has log10(c + ALPHA), added below, over its class's room; the end's is certain
            room = np.where(now == label[-1], 0.0, log_room[now])
            path = sum_by(log_step[before, now] - room, offsets + np.arange(len(offsets)))
            at = np.searchsorted(frequent, hashes)
            hit = frequent[np.minimum(at, len(frequent) - 1)] == hashes if len(frequent) else np.zeros(len(hashes), bool)
            c = np.where(hit, counts[np.minimum(at, max(len(counts) - 1, 0))], 0) if len(counts) else np.zeros(len(hashes))
            known_here = sum_by(hit[ids].astype(np.int64), offsets)
            logs = sum_by(np.where(hit, np.log10(c + ALPHA), 0.0)[ids], offsets)
            rare = np.flatnonzero(~hit[ids])
            doc = np.repeat(np.arange(len(m)), m)[rare]
            key, times = np.unique(doc * max(len(hashes), 1) + ids[rare], return_counts=True)
            owner = key // max(len(hashes), 1)
            bounds = np.searchsorted(owner, np.arange(len(m) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in keep), pa.array((pid << 40) + row + np.arange(len(m))), pa.array((m + 1).astype(np.int64)), pa.array(known_here), pa.array(logs), pa.array(path), pa.array([ends] * len(m), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(hashes[key % max(len(hashes), 1)] if len(hashes) else np.empty(0, np.int64))), pa.ListArray.from_arrays(pa.array(bounds), pa.array(times.astype(np.int32))),
                ],
                [*keep, row_, "n_tokens", known_, logs_, path_, ends_, h_, n_],
            )
            row += len(m)

    kinds = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep]
    schema = ", ".join([*kinds, f"{row_} long, n_tokens long, {known_} long, {logs_} double, {path_} double, {ends_} long, {h_} array<long>, {n_} array<int>"])
    made = stored(docs.select(*keep, F.col(text).alias(text_)).mapInArrow(run, schema))
    asked = made.select(row_, F.explode(F.arrays_zip(F.col(h_).alias("h"), F.col(n_).alias("n"))).alias("w")).select(row_, F.col("w.h").alias("h"), F.col("w.n").alias("n"))
    c = F.coalesce("c", F.lit(0))
    rare = asked.join(model.words.select("h", "c"), "h", "left").groupBy(row_).agg(F.sum(F.col("n") * F.log10(c + ALPHA)).alias(more_), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias(found_))
    whole = made.drop(h_, n_).join(rare, row_, "left")
    # the end's count is one for each training text, broadcast or not
    ends = F.coalesce(ends_, F.lit(model.words.where(F.col("h") == END_HASH).agg(F.sum("c")).first()[0] or 0))
    logs = F.col(logs_) + F.coalesce(more_, F.lit(0.0))
    room = float(np.log10(model.total + ALPHA * (model.distinct + 1)))
    return whole.select(
        *keep, "n_tokens", (F.col(known_) + F.coalesce(found_, F.lit(0)) + (ends > 0).cast("long")).alias("n_known"),
        (logs + F.log10(ends + ALPHA) - F.col("n_tokens") * room).alias("base_score"), (logs + F.col(path_)).alias("score"),
    )


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; see fit and score for odd rows."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(crc_fold("doc_id", 5) == 1, F.lit(False)).alias("held_out"))
    model = fit(docs.where("NOT held_out"))
    out = score(docs, model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
