"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of the [63, 57] Hamming code over the first 63 bits of a fingerprint: a perfect covering code of
radius 1. Two fingerprints at distance 2 or less have a point between them at distance 1 or less from both; the anchor
nearest to that point is at radius + 1 or less from both. So each fingerprint is replicated to the anchors of all points
at distance 1 or less, 32 of them, and every linked pair meets at one. An anchor's cell holds at most 2 * (1 + 63 + 63 * 31)
different fingerprints, so no group can grow with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import drop, slices, small_batches, split_words, stored, table, text_bytes, without

SEED = 42
#: rows of about 50 bytes that are sent to all executors at most
MOST_BROADCAST = 1_000_000
#: a node with more edges than this is a hub
HUB = 100_000


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets by text, XXH64 of each shingle). Fewer words than width: the whole sequence; none: no hash."""
    offsets, words = split_words(texts, lower=True)
    n = np.diff(offsets)
    starts, data = text_bytes(pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), words), " "))
    size = pc.binary_length(words).to_numpy().astype(np.int64)
    # in the joined text a word follows the one before it by one space
    before = np.concatenate([[0], np.cumsum(size + 1)])
    first = before[:-1] + np.repeat(starts[:-1] - before[offsets[:-1]], n)
    last = first + size
    per_doc = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out = np.concatenate([[0], np.cumsum(per_doc)])
    d = np.repeat(np.arange(len(n)), per_doc)
    i = offsets[:-1][d] + np.arange(out[-1]) - out[:-1][d]
    j = np.minimum(i + width, offsets[1:][d]) - 1
    raw, h = data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((h(raw[a:b], SEED) for a, b in zip(first[i].tolist(), last[j].tolist(), strict=True)), np.uint64, count=len(i))
    return out, hashes


def fingerprints(texts: pa.Array, width: int = 3) -> np.ndarray:
    """A bit is 1 if it is set in over half of the shingles' hashes; no words: 0."""
    offsets, hashes = shingle_hashes(texts, width)
    made = np.zeros(len(texts), np.uint64)
    weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for a in range(len(texts)):
        h = hashes[offsets[a] : offsets[a + 1]]
        if len(h):
            ones = np.zeros(64, np.int64)
            for k in range(0, len(h), 65536):
                ones += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            made[a] = weight[2 * ones > len(h)].sum(dtype=np.uint64)
    return made


def with_fingerprint(df: DataFrame, keep: list[str], text: str = "text", width: int = 3) -> DataFrame:
    """The columns `keep` and fp (long: the 64 bits). Null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 4 << 20):
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(fingerprints(batch.column("_text"), width).view(np.int64))], [*keep, "fp"])

    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep]
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, ", ".join([*kinds, "fp long"]))


def anchors(fp: np.ndarray, bits: int = 63) -> tuple[np.ndarray, np.ndarray]:
    """([n, bits + 1] code words, which of them to take): anchors of a fingerprint's lowest bits and of their neighbours at distance 1.

    `bits` is 2**r - 1, the length of a Hamming code. Bits are numbered from 1; the syndrome of a word is the XOR of the numbers
    of its set bits, and flipping the bit with that number gives the nearest code word. Higher bits are left out. From a point
    with syndrome s, flipping bit p leads to syndrome s ^ p; flips of p and s ^ p lead to the same anchor.
    """
    number = np.arange(1, bits + 1, dtype=np.uint64)
    x = fp.astype(np.uint64) & np.uint64(2**bits - 1)
    s = np.zeros(len(x), np.uint64)
    for p in number:
        s ^= np.where(x >> (p - np.uint64(1)) & np.uint64(1), p, np.uint64(0))
    flip = np.concatenate([[0], np.uint64(1) << (number - np.uint64(1))]).astype(np.uint64)
    q = np.arange(bits + 1, dtype=np.uint64)[None, :]
    other = s[:, None] ^ q
    # the point, after flipping bit q (0: none), decoded by flipping bit s ^ q
    code = x[:, None] ^ flip[q.astype(np.int64)] ^ flip[other.astype(np.int64)]
    first = q < other
    first[s == 0] = q[0] == 0  # a code word: all neighbours are nearest to it
    return code, first


def anchored(fps: DataFrame) -> DataFrame:
    """(anchor, fp) of different fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(k, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                code, first = anchors(fp)
                own = np.repeat(fp, first.sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(code[first].view(np.int64)), pa.array(own.view(np.int64))], ["anchor", "fp"])

    return fps.mapInArrow(run, "anchor long, fp long")


def links(fps: DataFrame, most: int = 2) -> DataFrame:
    """(a, b), a < b in signed order: for each anchor a spanning forest of its fingerprints' links at `most` bits or fewer."""
    if not 0 <= most <= 2:
        raise ValueError("the anchors cover distances up to 2")
    # 8 bytes become 32 rows: as many tasks as shuffles have, however few hold the fingerprints
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = anchored(fps.repartition(parts)).groupBy("anchor").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1").select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for cell in batch.column(0):
                x = np.sort(cell.values.to_numpy(zero_copy_only=False))
                if len(x) == 2:
                    if (int(x[0] ^ x[1]) & (2**64 - 1)).bit_count() <= most:
                        found.add((int(x[0]), int(x[1])))
                    continue
                seen = np.zeros(len(x), bool)
                for root in range(len(x)):
                    if seen[root]:
                        continue
                    seen[root], queue = True, [root]
                    while queue:
                        i = queue.pop()
                        near = np.flatnonzero(~seen & (np.bitwise_count((x ^ x[i]).view(np.uint64)) <= most))
                        seen[near] = True
                        queue += near.tolist()
                        found |= {(int(x[root]), int(x[j])) for j in near}
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return cells.mapInArrow(run, "a long, b long")


def with_least(edges: DataFrame, node: str, value: str, kept: list[str]) -> DataFrame:
    """edges with m, the least `value` of their `node`.

    Least values are grouped with partial sums. A hub, a node of more than HUB edges, would bring all its edges to one task of
    the join: hubs are broadcast instead. They are at most as many as all edges over HUB, which rises where that is above
    MOST_BROADCAST.
    """
    least = stored(edges.groupBy(node).agg(F.min(value).alias("m"), F.count("*").alias("n")), kept)
    total, top = least.agg(F.sum("n"), F.max("n")).first()
    bar = max(HUB, (total or 0) // MOST_BROADCAST)
    if (top or 0) <= bar:
        return edges.join(least.drop("n"), node)
    hubs = F.broadcast(least.where(F.col("n") > bar).drop("n"))
    rest = edges.join(hubs.select(node), node, "left_anti").join(least.where(F.col("n") <= bar).drop("n"), node)
    return edges.join(hubs, node).unionByName(rest)


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches. Nodes without an edge are absent.

    Alternates large-star and small-star steps; each round is written to the shared folder. Stars hang leaves on a
    minimum, which is a grouped minimum and a join; see with_least for nodes of very many edges.
    """
    spark = edges.sparkSession
    kept: list[str] = []
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), kept)
    state = None
    for _ in range(most_rounds):
        both = now.union(now.select("lo", "hi")).toDF("u", "v")
        large = with_least(both, "u", "v", kept).where("v > u").select(F.col("v").alias("hi"), F.least("u", "m").alias("lo"))
        large = stored(large.where("hi <> lo").distinct(), kept)
        small = with_least(large, "hi", "lo", kept).select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
        now = stored(small.where("hi <> lo").distinct(), kept)
        size = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        for path in kept[:-1]:
            drop(spark, path)
        del kept[:-1]
        if size == state:
            break
        state = size
    else:
        raise RuntimeError("components did not settle")
    # settled: every edge is (node, root)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select("lo", "lo").distinct())


def wide_hash(columns: list[str]) -> Column:
    """32 hex digits of two 64-bit hashes of the columns' values: no two rows in sight of any table agree by chance."""
    values = [F.col(f"`{c}`") for c in columns]
    return F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), *values)), 16, "0") for seed in ("first", "second")))


def near_classes(docs: DataFrame, keep: list[str], text: str = "text", width: int = 3, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """(docs' columns `keep` with fp, classes (fp, root)): equal roots mean linked by a chain. Fingerprints without a link have no class.

    Exact copies share one fingerprint, and only different ones go to the anchors. A column of `keep` named fp is replaced.
    Null and empty texts have fingerprint 0 and are linked like any other; no rows: no rows.
    """
    keep = without(keep, ["fp"])
    made = stored(with_fingerprint(docs, keep, text, width))
    found = components(links(made.select("fp").distinct(), most))
    return made, found.select(F.col("node").alias("fp"), "root")


def component_ids(made: DataFrame, classes: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """made with component_id: the smallest doc_id of the class (null only if all its ids are null)."""
    made = made.select(without(made.columns, ["component_id"]))
    least = made.groupBy("fp").agg(F.min(doc_id).alias("least"))
    whole = least.join(classes, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = whole.select("fp", "root").join(roots, "root").select("fp", "component_id")
    return made.join(by_fp, "fp", "left")


def hexed(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; see near_classes and component_ids for odd rows."""
    small_batches(spark)
    made, classes = near_classes(table(spark, sf_dir, "documents"), ["doc_id"])
    return component_ids(made, classes).select("doc_id", hexed("fp").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", near: Callable[[DataFrame, list[str], str], tuple[DataFrame, DataFrame]] = near_classes) -> DataFrame:
    """docs without near copies: of each class that `near` finds the row with the smallest doc_id stays (null ids last, then by the row's hash).

    Repeated rows count as copies. Columns stay as they are; only names that begin with _thicket_ are not theirs to take. The texts are read once more against the rows that go, which
    are broadcast if there are at most MOST_BROADCAST; beyond that they meet in a join that adaptive execution may split.
    """
    keyed = docs.withColumn("_thicket_row", wide_hash(docs.columns))
    made, classes = near(keyed.select(F.col(doc_id).alias("_thicket_id"), "_thicket_row", F.col(text).alias("_thicket_text")), ["_thicket_id", "_thicket_row"], "_thicket_text")
    doc_id = "_thicket_id"
    order = F.struct(F.col(doc_id).isNull().alias("n"), F.col(doc_id).alias("i"), F.col("_thicket_row").alias("r"))
    by_fp = made.groupBy("fp").agg(F.min(order).alias("first")).join(classes, "fp", "left")
    best = by_fp.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    chosen = best.select(F.col("first.r").alias("_thicket_row"), F.lit(True).alias("_thicket_first"))
    times = made.groupBy("_thicket_row").agg(F.count("*").alias("_thicket_n"))
    # the rows that do not simply stay: copies, and rows that are there more than once
    few = times.join(chosen, "_thicket_row", "left").where("_thicket_first IS NULL OR _thicket_n > 1").select("_thicket_row", F.col("_thicket_first").isNull().alias("_thicket_goes"))
    few = stored(few)
    n, repeated = few.agg(F.count("*"), F.sum(F.when(F.col("_thicket_goes"), 0).otherwise(1))).first()
    marked = keyed.join(F.broadcast(few) if n <= MOST_BROADCAST else few, "_thicket_row", "left")
    out = marked.where("_thicket_goes IS NULL")
    if repeated:
        out = out.unionByName(marked.where("NOT _thicket_goes").dropDuplicates(["_thicket_row"]))
    return out.select(docs.columns)
