"""Best-fit packing by a configuration linear program over the length histogram.

Documents are tokenised once into pieces of at most `capacity` tokens. The histogram of piece lengths has at most
`capacity` entries, whatever the input, and goes to the driver. There multiplicative weights solve the configuration
program: each length has a price, a knapsack by dynamic programming finds the configurations of the greatest price that fit
a sequence, and the prices of the lengths they hold fall, until all pieces are covered and prices prove the cover near the
least possible. The fractional counts are rounded; only the rounding's rest is filled best fit on the histogram. Pieces of one length are interchangeable, so each takes the slot of its rank
among its length's pieces, which partition counts give without a sort of the data.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from json import load

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.llm.common import slices, small_batches, stored, table

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k"
SPACES = re.compile(r"\s\s")
SINGLE = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Byte-level BPE ids of whole texts as little-endian uint32 bytes, with a bounded memory of pieces.

    The strings of added tokens become their ids, as the tokenizers library has it; plain() takes them as ordinary text.

    The tokenizer always ends a token at a single space between two non-spaces, so what stands between such spaces can be
    encoded alone and remembered. `json` names the vocabulary for the tokenizers library; the ranks file beside it holds
    the same vocabulary, which tiktoken merges several times faster (a test compares both).
    """

    def __init__(self, json: str, most: int = 400_000):
        import public_tokenizers
        import tiktoken

        with open(json, "rb") as f:
            added = {t["content"]: int(t["id"]) for t in load(f)["added_tokens"]}
        # longest first, so that of two that begin alike the longer is found
        self.added = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.added_ids = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        with open(json.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("thicket", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        encode = coder.encode_ordinary

        class Memory(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = np.array(encode(piece), "<u4").tobytes()
                if len(self) >= most:
                    self.clear()
                if len(piece) <= 40:
                    self[piece] = ids
                return ids

        self.memory = Memory()

    def __call__(self, text: str) -> bytes:
        if self.added is None or not self.added.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.added.finditer(text):
            out += [self.plain(text[at : m.start()]), self.added_ids[m[0]]]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        parts = (SINGLE.split(text) if SPACES.search(text) else text.split(" ")) if " " in text else [text]
        found = self.memory
        return found[parts[0]] + b"".join([found[" " + p] for p in parts[1:]])


_encoders: dict[str, Encoder] = {}


def encoder(json: str) -> Encoder:
    """One in each Python worker."""
    if json not in _encoders:
        _encoders[json] = Encoder(json)
    return _encoders[json]


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, pid, nth): nth counts the pieces of one length within partition pid.

    A text's ids and then `end`; null texts are empty and have the end alone. A document longer than the capacity is cut
    into full pieces, and what is over comes first. nth and pid are only stable once written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pid, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        last = np.array([end], "<u4").tobytes()
        for batch in slices(batches, "_text"):
            row, piece, start, length, crc, nth = [], [], [], [], [], []
            for i, t in enumerate(batch.column("_text").to_pylist()):
                ids = encode(t or "") + last
                n = len(ids) // 4
                at, k = 0, (n - 1) % capacity + 1
                j = 0
                while at < n:
                    row.append(i)
                    piece.append(j)
                    start.append(at)
                    length.append(k)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + k)]))
                    nth.append(int(seen[k]))
                    seen[k] += 1
                    at, k, j = at + k, capacity, j + 1
            own = batch.column("_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [own, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([pid] * len(row), pa.int32()), pa.array(nth, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "pid", "nth"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, pid int, nth long")


def knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """(greatest total price of lengths, with repeats, that fit in each room from 0 on; the length to take there, 0 for none).

    price[l] is that of length l, 0 where there is none.
    """
    value, choice, best = np.zeros(capacity + 1), [0] * (capacity + 1), 0.0
    kinds = np.flatnonzero(price > 0)
    prices, names = price[kinds], kinds.tolist()
    upto = np.searchsorted(kinds, np.arange(capacity + 1), side="right").tolist()
    for room in range(1, capacity + 1):
        if e := upto[room]:
            gains = prices[:e] + value[room - kinds[:e]]
            k = gains.argmax()
            if gains[k] > best:
                best, choice[room] = float(gains[k]), names[k]
        value[room] = best
    return value, choice


def configuration(choice: list[int], room: int, first: int = 0) -> dict[int, int]:
    """How often each length stands in the best filling of the room, beside `first` (0: nothing)."""
    out = {first: 1} if first else {}
    while room > 0:
        if k := choice[room]:
            out[k] = out.get(k, 0) + 1
            room -= k
        else:
            room -= 1
    return out


@dataclass
class Program:
    """A fractional cover of the counts: {configuration as (length, times) pairs: how often}, and a lower bound from prices."""

    made: dict[tuple[tuple[int, int], ...], float]
    bound: float

    @property
    def gap(self) -> float:
        return sum(self.made.values()) / self.bound - 1 if self.bound else 0.0


def covered(counts: np.ndarray, capacity: int, step: float, eta: float = 10.0, near: float = 0.05, most: int = 256) -> Program:
    """The configuration program by multiplicative weights.

    The price of a length starts in proportion to it, as a full sequence costs one, and falls by exp(-eta * part) with the
    part of its pieces that is covered. Each round one knapsack prices all configurations; of those within `near` of the best,
    one for each length that holds it (`most` at once), each is given as often as covers a `step` of its scarcest length.
    A round's prices over the best configuration's price, and their mean over rounds, are feasible in the dual, and so bound
    what any packing needs. It ends when every piece is covered.
    """
    lengths = np.flatnonzero(counts)
    n = counts[lengths].astype(np.float64)
    total, names = dict(zip(lengths.tolist(), n.tolist(), strict=True)), lengths.tolist()
    left, made = dict(total), {}
    bound, mean = float(counts @ np.arange(capacity + 1)) / capacity, np.zeros(len(lengths))
    price = np.zeros(capacity + 1)
    while True:
        part = 1 - np.array([left[k] for k in names]) / n
        open_ = part < 1
        if not open_.any():
            break
        weight = lengths / capacity * np.exp(-eta * (part - part.min()))
        price[lengths] = np.where(open_, weight, 0.0)
        value, choice = knapsack(price, capacity)
        if open_.all():
            bound = max(bound, float(n @ weight / value[capacity]))
            mean += weight / value[capacity]
        some = lengths[open_]
        worth = price[some] + value[capacity - some]
        order = np.argsort(-worth, kind="stable")[:most]
        top = part.min() + step
        chosen = some[order[worth[order] >= worth.max() * (1 - near)]].tolist()
        behind = [k for k in chosen if 1 - left[k] / total[k] <= top]
        for k in behind or chosen[:1]:
            if left[k] <= 0:
                continue
            config = configuration(choice, capacity - k, k)
            fits = min(left[q] / t for q, t in config.items())
            if fits <= 0:
                continue
            x = max(min(fits, step * min(total[q] / t for q, t in config.items())), min(fits, 1.0))
            for q, t in config.items():
                rest = left[q] - x * t
                left[q] = rest if rest > 1e-9 * total[q] else 0.0
            name = tuple(sorted(config.items()))
            made[name] = made.get(name, 0.0) + x
    if mean.any():
        price[lengths] = mean
        value, _ = knapsack(price, capacity)
        bound = max(bound, float(n @ mean / value[capacity]))
    return Program(made, bound)


def solved(counts: np.ndarray, capacity: int, goal: float = 0.01, steps: Sequence[float] = (0.1, 0.05, 0.025)) -> Program:
    """The best cover of passes with finer and finer steps, up to the first whose duality gap is at most `goal`."""
    best, bound = None, 0.0
    for step in steps:
        got = covered(counts, capacity, step)
        bound = max(bound, got.bound)
        if best is None or sum(got.made.values()) < sum(best.made.values()):
            best = got
        if sum(best.made.values()) <= (1 + goal) * bound:
            break
    return Program(best.made, bound)


@dataclass
class Plan:
    """sequences: (lengths in a sequence, how many such sequences). by_program of them come from the program, bound is the least number possible as far as its prices prove, gap the program's duality gap."""

    sequences: list[tuple[np.ndarray, int]]
    by_program: int
    bound: float
    gap: float

    @property
    def total(self) -> int:
        return sum(times for _, times in self.sequences)


def pack_lengths(counts: np.ndarray, capacity: int = CAPACITY, goal: float = 0.01) -> Plan:
    """Every one of counts[l] pieces of each length l is in exactly one sequence.

    The program's counts are rounded down; then each configuration is used once more, greatest fraction first, if its pieces
    are still there. Only what no configuration takes goes best fit: the longest piece first, then the longest that still fits.
    """
    left = counts.astype(np.int64).copy()
    sequences: list[tuple[np.ndarray, int]] = []

    def use(kinds: np.ndarray, n: np.ndarray, times: int) -> None:
        times = min(times, int((left[kinds] // n).min()))
        if times > 0:
            left[kinds] -= times * n
            sequences.append((np.repeat(kinds, n)[::-1], times))

    full = int(left[capacity])
    if full:
        use(np.array([capacity]), np.array([1]), full)
    program = solved(left, capacity, goal) if left.any() else Program({}, 0.0)
    columns = [(*np.array(c, np.int64).T, x) for c, x in program.made.items()]
    for kinds, n, x in sorted(columns, key=lambda c: (-int(c[0] @ c[1]), -c[2])):
        use(kinds, n, int(x + 1e-9))
    for kinds, n, _ in sorted(columns, key=lambda c: (-round((c[2] + 1e-9) % 1, 6), -int(c[0] @ c[1]))):
        use(kinds, n, 1)
    by_program = sum(times for _, times in sequences)
    while left.any():
        room, taken = capacity, {}
        while room > 0:
            fit = np.flatnonzero(left[: room + 1])
            while len(fit) and taken.get(int(fit[-1]), 0) >= left[fit[-1]]:
                fit = fit[:-1]
            if not len(fit):
                break
            k = int(fit[-1])
            n = min(room // k, int(left[k]) - taken.get(k, 0))
            taken[k] = taken.get(k, 0) + n
            room -= n * k
        kinds = np.array(sorted(taken), np.int64)
        n = np.array([taken[k] for k in kinds.tolist()], np.int64)
        use(kinds, n, int((left[kinds] // n).min()))
    return Plan(sequences, by_program, program.bound + full, program.gap)


@dataclass
class Slots:
    """For each length (its part of the arrays between bounds[l] and bounds[l + 1]): from rank `low` on, the sequence number is `first` + rank - low, at `offset`."""

    bounds: np.ndarray
    low: np.ndarray
    first: np.ndarray
    offset: np.ndarray

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for k in np.unique(length):
            rows = np.flatnonzero(length == k)
            a, b = self.bounds[k], self.bounds[k + 1]
            i = a + np.searchsorted(self.low[a:b], rank[rows], side="right") - 1
            sequence[rows], offset[rows] = self.first[i] + rank[rows] - self.low[i], self.offset[i]
        return sequence, offset


def slots(plan: list[tuple[np.ndarray, int]], capacity: int = CAPACITY) -> Slots:
    used = np.zeros(capacity + 1, np.int64)
    rows, base = [], 0
    for config, times in plan:
        at = 0
        for k in config.tolist():
            rows.append((k, int(used[k]), base, at))
            used[k] += times
            at += k
        base += times
    a = np.array(rows, np.int64).reshape(-1, 4)
    a = a[np.lexsort((a[:, 1], a[:, 0]))]
    return Slots(np.searchsorted(a[:, 0], np.arange(capacity + 2)), a[:, 1], a[:, 2], a[:, 3])


def pack(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    Each row of docs is a document of its own, repeated rows and null ids too; other columns are not read. No documents: no
    rows. The slots that are broadcast depend on the capacity alone.
    """
    spark = docs.sparkSession
    made = stored(pieces(docs, tokenizer, text, doc_id, capacity, end))
    by_part = made.groupBy("length", "pid").agg(F.count("*").alias("n"))
    before = by_part.select("length", "pid", (F.sum("n").over(Window.partitionBy("length").orderBy("pid")) - F.col("n")).alias("before"))
    counts = np.zeros(capacity + 1, np.int64)
    for k, n in made.groupBy("length").count().collect():
        counts[k] = n
    shipped = spark.sparkContext.broadcast(slots(pack_lengths(counts, capacity).sequences, capacity))
    ranked = made.join(before, ["length", "pid"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = shipped.value.find(batch.column("length").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(f"{VOCABULARY}.json"))
