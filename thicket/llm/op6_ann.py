"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are projected to a few dimensions, and each of several random projections and shifts orders them along a Hilbert
curve. Spark range-partitions each ordering, with a code of a byte a component in place of the vector; a vector's place is
known from partition counts. A query's candidates are the codes within a window of places around its own on every curve; the
windows' shortlists merge, and the original vectors of those alone rerank them. The window is measured: a bounded sample of
queries meets all vectors, and the places of their true neighbours tell how far windows must reach for the wanted recall.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.llm.common import stored, table

DIMS, BITS = 8, 7


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer points [n, d] along the Hilbert curve of 2**bits cells a side, after Skilling (2004); d * bits is at most 62."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            set_ = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(set_, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve(c: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The projection [dim, DIMS] and shift of curve c."""
    rng = np.random.default_rng(1000 + c)
    return np.linalg.qr(rng.standard_normal((dim, min(DIMS, dim))))[0], rng.random(min(DIMS, dim))


def usable(vectors: DataFrame, vec_id: str, vec: str, dim: int | None) -> tuple[DataFrame, int]:
    """(vec_id, v): vectors that take part, and their length: the most frequent one unless given (of equally frequent ones the greatest); others take no part."""
    v = F.col(vec)
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v")).where(fine)
    if not dim:
        found = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dim = found["d"] if found else 1
    return rows.where(F.size("v") == dim), dim


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim)


def encoded(x: np.ndarray) -> list[bytes]:
    """A byte a component, in units of 1/127 of the vector's greatest, behind that unit as a float."""
    unit = np.abs(x).max(axis=1, initial=0.0) / 127
    codes = np.rint(x / np.maximum(unit, 1e-300)[:, None]).astype(np.int8)
    return [u + c.tobytes() for u, c in zip([f.tobytes() for f in unit.astype("<f8")], codes, strict=True)]


def decoded(codes: pa.Array, dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, 8 + dim)
    return raw[:, 8:].view(np.int8) * np.ascontiguousarray(raw[:, :8]).view("<f8")


def ordered(classes: DataFrame, dim: int, curves: int) -> DataFrame:
    """(curve, place, rep, code): the classes along each curve, places without gaps from 0 on."""
    scale = stretch(classes, dim)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), dim)
            code = pa.array(encoded(x), pa.binary())
            for c in range(curves):
                direction, shift = curve(c, dim)
                y = np.clip(((x / scale) @ direction / 8 + 0.5 + shift / 4 - 0.125) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(x), pa.int32()), pa.array(hilbert_keys(y, BITS)), batch.column("rep"), code], ["curve", "key", "rep", "code"])

    made = classes.select("rep", "v").mapInArrow(keys, "curve int, key long, rep long, code binary")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = made.repartitionByRange(parts, "curve", "key", "rep").sortWithinPartitions("curve", "key", "rep").withColumn("p", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            c = batch.column("curve").to_numpy(zero_copy_only=False)
            nth = np.empty(len(c), np.int64)
            for k in np.unique(c):
                rows = np.flatnonzero(c == k)
                nth[rows] = seen.get(int(k), 0) + np.arange(len(rows))
                seen[int(k)] = seen.get(int(k), 0) + len(rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("curve", "p")), pa.array(nth), batch.column("rep"), batch.column("code")], ["curve", "p", "nth", "rep", "code"])

    placed = stored(ranged.select("curve", "p", "rep", "code").mapInArrow(number, "curve int, p int, nth long, rep long, code binary"))
    by_part = placed.groupBy("curve", "p").agg(F.count("*").alias("n"))
    before = by_part.select("curve", "p", (F.sum("n").over(Window.partitionBy("curve").orderBy("p")) - F.col("n")).alias("before"))
    return placed.join(before, ["curve", "p"]).select("curve", (F.col("before") + F.col("nth")).alias("place"), "rep", "code")


def stretch(classes: DataFrame, dim: int) -> float:
    """The root mean square of the components, so that most projections lie within the grid."""
    total, n = classes.agg(F.sum(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), F.count("*")).first()
    return float(np.sqrt(total / (n * dim))) if n and total else 1.0


def shortlists(placed: DataFrame, queries: DataFrame, dim: int, window: int, most: int, share: float, block: int = 4096) -> DataFrame:
    """(q, rep, d): for each query and curve the `most` classes nearest by their codes within `window` places, block by block.

    share: about how many queries there are for a class. A block holds at most `block` classes; if windows bring more than
    some thousand queries to a block, its classes are copied and the queries dealt over the copies.
    """
    block = min(block, max(256, window))
    lanes = max(1, int((2 * window + block) * share // 8192))
    lane = F.explode(F.array(*[F.lit(i) for i in range(lanes)]))
    data = placed.select("curve", F.expr(f"place div {block}").alias("b"), lane.alias("lane"), "place", "rep", "code", F.lit(None).cast("long").alias("q"))
    at = placed.join(queries.select("rep"), "rep")
    reached = F.explode(F.sequence(F.expr(f"greatest(place - {window}, 0L) div {block}"), F.expr(f"(place + {window}) div {block}")))
    dealt = F.pmod(F.xxhash64("rep"), F.lit(lanes).cast("long")).cast("int")
    asked = at.select("curve", reached.alias("b"), dealt.alias("lane"), "place", F.lit(None).cast("long").alias("rep"), "code", F.col("rep").alias("q"))
    pairs = data.join(asked.select("curve", "b", "lane").distinct(), ["curve", "b", "lane"], "left_semi").unionByName(asked)

    def nearest(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        is_query = pc.is_null(rows["rep"])
        queries, data = rows.filter(is_query), rows.filter(pc.invert(is_query))
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if queries.num_rows and data.num_rows:
            x, rep, place = decoded(data["code"], dim), data["rep"].to_numpy(), data["place"].to_numpy()
            length = np.einsum("ij,ij->i", x, x)
            for a in range(0, queries.num_rows, 256):
                some = queries.slice(a, 256)
                v, own, at = decoded(some["code"], dim), some["q"].to_numpy(), some["place"].to_numpy()
                d = length[None, :] - 2 * (v @ x.T) + np.einsum("ij,ij->i", v, v)[:, None]
                d[np.abs(place[None, :] - at[:, None]) > window] = np.inf
                near = np.argpartition(d, most - 1, axis=1)[:, :most] if d.shape[1] > most else np.broadcast_to(np.arange(d.shape[1]), d.shape)
                found = np.take_along_axis(d, near, axis=1)
                i, j = np.nonzero(np.isfinite(found))
                out.append((own[i], rep[near[i, j]], found[i, j]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["q", "rep", "d"])

    return pairs.groupBy("curve", "b", "lane").applyInArrow(nearest, "q long, rep long, d double")


def nearest_of(found: DataFrame, k: int) -> DataFrame:
    """The k nearest different classes of each query, over all curves and blocks."""
    order = Window.partitionBy("q").orderBy("d", "rep")
    return found.groupBy("q", "rep").agg(F.min("d").alias("d")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def reranked(pairs: DataFrame, queries: DataFrame, classes: DataFrame, dim: int, k: int) -> DataFrame:
    """(q, rep, d): the k nearest of the pairs (q, rep) by the original vectors, which only they are joined with."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = matrix(batch.column("v"), dim) - matrix(batch.column("w"), dim)
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("rep"), pa.array(np.sqrt(np.einsum("ij,ij->i", d, d)))], ["q", "rep", "d"])

    both = pairs.join(classes.select("rep", "v"), "rep").join(queries.select(F.col("rep").alias("q"), F.col("v").alias("w")), "q")
    return nearest_of(both.select("q", "rep", "v", "w").mapInArrow(measure, "q long, rep long, d double"), k)


def true_neighbours(classes: DataFrame, some: list, dim: int, k: int) -> set[tuple[int, int]]:
    """(q, rep) by brute force: the few queries go to all classes where they lie; each task sends k for each query."""
    shipped = classes.sparkSession.sparkContext.broadcast([(r["rep"], np.array(r["v"], np.float64)) for r in some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {q: (np.empty(0), np.empty(0, np.int64)) for q, _ in shipped.value}
        for batch in batches:
            x, rep = matrix(batch.column("v"), dim), batch.column("rep").to_numpy(zero_copy_only=False)
            for q, v in shipped.value:
                d = x - v
                d = np.concatenate([best[q][0], np.sqrt(np.einsum("ij,ij->i", d, d))])
                r = np.concatenate([best[q][1], rep])
                keep = np.lexsort((r, d))[:k]
                best[q] = d[keep], r[keep]
        for q, (d, r) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), q)), pa.array(r), pa.array(d)], ["q", "rep", "d"])

    found = nearest_of(classes.select("rep", "v").mapInArrow(run, "q long, rep long, d double"), k)
    return {(r["q"], r["rep"]) for r in found.collect()}


def measured(placed: DataFrame, classes: DataFrame, queries: DataFrame, dim: int, k: int, wanted: float, sample: int) -> tuple[int, float]:
    """(window, recall): the least window that holds the wanted share of the true neighbours of `sample` queries, drawn by hash, on some curve."""
    some = queries.orderBy(F.xxhash64("rep")).limit(sample).collect()
    true = true_neighbours(classes, some, dim, k)
    if not true:
        return k, 1.0
    ids = sorted({i for pair in true for i in pair})  # at most sample * (k + 1)
    places: dict[int, dict[int, int]] = {}
    for c, place, rep in placed.where(F.col("rep").isin(ids)).select("curve", "place", "rep").collect():
        places.setdefault(rep, {})[c] = place
    far = np.sort([min(abs(places[q][c] - places[r][c]) for c in places[q]) for q, r in true])
    window = max(int(far[min(len(far) - 1, int(np.ceil(wanted * len(far))) - 1)]), k)
    return window, float((far <= window).mean())


@dataclass
class Found:
    """neighbours: (query_id, rank, vec_id, score); the window of places on each curve, and the recall it has on the sample."""

    neighbours: DataFrame
    window: int
    recall: float


SALTS = 8


def search(vectors: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", vec: str = "embedding", curves: int = 8, wanted: float = 0.95, sample: int = 128, shortlist: int = 64, dim: int | None = None) -> Found:
    """For each row that is_query (a condition on vec_id) holds for, the k nearest other rows.

    score is the Euclidean distance of the original vectors in double precision, ties go to the smaller vec_id, and all
    candidates come back if there are fewer than k. Vectors that are null, zero, of another length than `dim`, or hold null
    or non-finite components take no part; nor do rows with a null vec_id. Equal vectors are searched as one: only the
    k + 1 smallest ids of each can be among any k nearest, so a vector that a third of the rows share is reduced before
    the shuffle; rows that repeat an id and vector count once. Windows reach as far as `sample` queries (the bound of the fit)
    need for the wanted recall, the same on all curves for any number of rows; `shortlist` classes a query, nearest by their
    codes, are reranked. No rows or no queries: no neighbours. Other columns are not read.
    """
    rows, dim = usable(vectors.where(F.col(vec_id).isNotNull()), vec_id, vec, dim)
    same = Window.partitionBy("v").orderBy("vec_id")
    members = stored(rows.withColumn("r", F.dense_rank().over(same)).where(F.col("r") <= k + 1).distinct().withColumn("rep", F.min("vec_id").over(Window.partitionBy("v"))).drop("r"))
    classes = stored(members.where("vec_id = rep").select("rep", "v"))
    # many queries may share one vector: they meet its class in salted parts
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS).cast("long")).alias("salt")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    asked = rows.where(is_query).select("vec_id", "v", salt).distinct()
    wanted_classes = stored(asked.select("v").distinct().join(classes, "v").select("rep", "v"))
    queries = stored(asked.join(wanted_classes.select("v", "rep", salts), ["v", "salt"]).select(F.col("vec_id").alias("query_id"), "rep", "salt"))
    n, n_queries = classes.count(), wanted_classes.count()
    placed = stored(ordered(classes, dim, curves))
    window, recall = measured(placed, classes, wanted_classes, dim, k + 1, wanted, sample)
    near = nearest_of(shortlists(placed, wanted_classes, dim, window, max(shortlist, 2 * (k + 1)), n_queries / max(n, 1)), max(shortlist, 2 * (k + 1)))
    found = reranked(near.select("q", "rep"), wanted_classes, classes, dim, k + 1)
    each = found.join(members.select("rep", "vec_id"), "rep")
    first = Window.partitionBy("q").orderBy("d", "vec_id")
    # a class of queries has k + 1 answers; each of its queries leaves out itself
    best = each.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select(F.col("q").alias("rep"), "d", "vec_id", salts)
    answers = queries.join(best, ["rep", "salt"]).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))
    return Found(answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("d").alias("score")), window, recall)


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score), and the recall of the windows as measured on the sample; see search for odd rows."""
    found = search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.neighbours.withColumn("sample_recall", F.lit(found.recall))
