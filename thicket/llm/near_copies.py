"""Near copies by the Jaccard similarity of texts' five-word shingles: SimHash, anchor-point covering, exact similarities.

A text's fingerprint has 2,048 bits, each the majority of one bit of its different shingles' hashes, in 64 blocks of 32. The
anchors of a block are the words of the [31, 26] Hamming code (its last bit is left out): as in op9, a block is replicated to the
anchors of all points at distance 1 or less, 16 of them, so blocks at distance 2 or less always meet (and some 18 % of those at
3 or 4). Texts that meet are a candidate if the 128 bits of the next four blocks differ in NEAR_BITS or fewer. Sets of similarity
0.8 have a cosine of 8/9 or more, so a bit differs with a chance of acos(8/9) / pi = 0.15 at most, and no block of a pair meets with a chance of
1e-6 (simulated chance of one block to the 64th power). Fingerprints of few shingles are coarser (0.1875 for 4 of 5 shingles):
texts of up to SHORT different ones also meet by 40 bands of 6 MinHash values, none of which agrees with a chance of 5.2e-6 at 0.8.

Candidates, directly or over others, form a block of texts, and in it every pair of texts that is
not linked yet is decided by its exact similarity: none is cut, however many a block holds. A block of more than
PART_TEXTS texts is dealt in parts: texts are linked within parts, then the parts' groups by one text of each, and what is
still apart from the block's largest group meets every part, slice by slice. So no task holds more than two parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm.common import give_back, slices, small_batches, stored
from thicket.llm.op9_simhash import MOST_BROADCAST, anchors, components, shingle_hashes, wide_hash

WIDTH = 5
#: blocks of a fingerprint, 32 bits each, of which anchors cover CODE
BLOCKS, CODE = 64, 31
NEAR_BITS = 40
#: a text's place in a block: its id, the block, and the next four blocks
POINT = np.dtype([("id", "<i8"), ("word", "<u4"), ("check", "<u4", 4)])
#: a task holds about so many points at once, and sorts so many anchors
POINTS, ANCHORS = 1_000_000, 2_000_000
SHORT = 16
BANDS, ROWS = 40, 6
#: similarity of 4 / 5 or more: shared * (4 + 5) >= 4 * (shingles of both)
PART, WHOLE = 4, 5
#: a part of a block holds about so many texts and shingles at most (a single longer text is a part)
PART_TEXTS, PART_SHINGLES = 1000, 4_000_000
_rng = np.random.default_rng(42)
FACTORS = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
WIDE = _rng.integers(0, 2**63, BLOCKS // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WIDE_SHIFTS = _rng.integers(0, 2**63, BLOCKS // 2, dtype=np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def bands(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """[texts, BANDS] keys of texts that each have a shingle."""
    keys = np.empty((len(offsets) - 1, BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(keys), b, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            key = mixed(key * MIX + np.minimum.reduceat(hashes * FACTORS[k] + SHIFTS[k], offsets[:-1]))
        keys[:, b] = key
    return keys


def wide_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """[sets, BLOCKS]: a bit is 1 if it is set in over half of the set's hashes, mixed anew for each 64 bits."""
    made = np.zeros((len(sets), BLOCKS * 4), np.uint8)
    for i, s in enumerate(sets):
        ones = np.zeros(BLOCKS * 32, np.int64)
        for k in range(0, len(s), 252):  # counts of one byte
            ones += np.unpackbits(mixed(s[k : k + 252, None] * WIDE + WIDE_SHIFTS).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
        made[i] = np.packbits(2 * ones > len(s), bitorder="little")
    return made.view(np.uint32)


def with_fingerprints(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The columns `keep`, fp (the text's hash in 32 digits; empty without a word), n (shingles), bits (the wide fingerprint) and keys (bands of a text of up to SHORT different shingles, else none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in slices(batches, "_text", 1 << 19):
            offsets, hashes = shingle_hashes(batch.column("_text"), WIDTH)
            n = np.diff(offsets)
            sets = [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            bits = wide_fingerprints(sets)
            size = np.array([len(s) for s in sets], np.int64)
            few = (size > 0) & (size <= SHORT)
            own = [s for s, f in zip(sets, few.tolist(), strict=True) if f]
            keys = bands(np.concatenate([[0], np.cumsum(size[few])]), np.concatenate(own)).view(np.int64) if own else np.empty(0, np.int64)
            at = np.concatenate([[0], np.cumsum(few * BANDS)]).astype(np.int32)
            fp = pc.if_else(pa.array(n > 0), batch.column("fp"), "")
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), fp, pa.array(n), pa.array([b.tobytes() for b in bits], pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel()))],
                [*keep, "fp", "n", "bits", "keys"],
            )
        give_back()

    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep]
    asked = df.select(*keep, wide_hash([text]).alias("fp"), F.col(text).alias("_text"))
    return asked.mapInArrow(run, ", ".join([*kinds, "fp string", "n long", "bits binary", "keys array<long>"]))


def near_bits(check: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(check[i] ^ check[j]).sum(axis=-1, dtype=np.int64) <= NEAR_BITS


def forest(check: np.ndarray, cell: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the candidates among the places `cell`."""
    found, left = [], cell
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = near_bits(check, i, left)
            found += [(i, j) for j in left[near].tolist()]
            queue += left[near].tolist()
            left = left[~near]
    return found


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of 0 .. n - 1 that each reaches over the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def meeting(points: np.ndarray, shard: int = 0, shards: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Ids (a, b): of POINTs of one block, the least that each reaches over candidates that meet at an anchor of the shard, and itself if it is another."""
    points = points[np.argsort(points["id"])]
    word, check = points["word"].copy(), np.ascontiguousarray(points["check"]).view(np.uint64)
    # 16 anchors a point, of which a shard holds some
    times = -(-len(points) * (CODE + 1) // (2 * shards.bit_length() * ANCHORS))
    root = np.arange(len(points))
    for t in range(times):
        keys, places = [], []
        for k in range(0, len(word), 16384):
            code, mine = anchors(word[k : k + 16384], CODE)
            if shards > 1:
                mine &= code % np.uint64(shards) == shard
            if times > 1:
                mine &= mixed(code) % np.uint64(times) == t
            keys.append(code[mine].astype(np.uint32))
            places.append((k + np.nonzero(mine)[0]).astype(np.int32))
        key, at = np.concatenate(keys), np.concatenate(places)
        order = np.argsort(key)
        key, at = key[order], at[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(start, append=len(key))
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for o in range(1, 8):  # small cells: all pairs, by how far apart they stand
            some = (size > o) & (size <= 8)
            i = np.repeat(start[some], size[some] - o) + np.arange((size[some] - o).sum()) - np.repeat(np.cumsum(size[some] - o) - (size[some] - o), size[some] - o)
            i, j = at[i].astype(np.int64), at[i + o].astype(np.int64)
            near = near_bits(check, i, j)
            a.append(i[near])
            b.append(j[near])
        for k in np.flatnonzero(size > 8).tolist():
            found = np.array(forest(check, np.sort(at[start[k] : start[k] + size[k]])), np.int64).reshape(-1, 2)
            a.append(found[:, 0])
            b.append(found[:, 1])
        # what earlier passes linked goes on as one edge each
        a.append(root)
        b.append(np.arange(len(root)))
        root = least_reached(len(points), np.concatenate(a), np.concatenate(b))
    own = np.flatnonzero(root != np.arange(len(root)))
    return points["id"][root[own]], points["id"][own]


def candidates(texts: DataFrame) -> DataFrame:
    """(a, b): ids that link all candidates of texts (id, bits), one edge a text for each block and shard at most. Beyond POINTS texts the anchors of a block are dealt in shards, and a text goes to those that hold one of its own."""
    n, shards = texts.count(), 1
    while n * shards.bit_length() > POINTS * shards and shards < 2**CODE:
        shards *= 2

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint32).reshape(-1, BLOCKS)
            units, blobs = [], []
            for j in range(BLOCKS):
                points = np.empty(len(bits), POINT)
                points["id"], points["word"], points["check"] = batch.column("id").to_numpy(), bits[:, j], bits[:, [(j + k) % BLOCKS for k in range(1, 5)]]
                if shards == 1:
                    units.append(j)
                    blobs.append(points.tobytes())
                    continue
                code, mine = anchors(bits[:, j], CODE)
                to = np.unique((code % np.uint64(shards)).astype(np.int64)[mine] * len(bits) + np.nonzero(mine)[0])
                shard, first = np.unique(to // len(bits), return_index=True)
                units += (j * shards + shard).tolist()
                blobs += [points[x % len(bits)].tobytes() for x in np.split(to, first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(blobs, pa.binary())], ["unit", "points"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(unit: int, held: list[bytes]) -> pa.RecordBatch:
            a, b = meeting(np.frombuffer(b"".join(held), POINT), unit % shards, shards)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        give_back()
        unit, held = None, []
        for batch in batches:
            for u, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if u != unit and held:
                    yield found(unit, held)
                    held = []
                unit = u
                held.append(blob)
        if held:
            yield found(unit, held)
        del held
        give_back()

    dealt_out = texts.select("id", "bits").mapInArrow(deal, "unit long, points binary").repartition(min(BLOCKS * shards, 4096), "unit").sortWithinPartitions("unit")
    spark = texts.sparkSession
    small_batches(spark, 256)
    made = stored(dealt_out.mapInArrow(meet, "a long, b long"))
    small_batches(spark)
    return made


def shingle_sets(df: DataFrame, text: str, row: str, members: DataFrame) -> DataFrame:
    """(id, block, part, set): the different shingles of the texts whose row is in members (id, block, part, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in slices(batches, "_text", 1 << 19):
            offsets, hashes = shingle_hashes(batch.column("_text"), WIDTH)
            sets = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("id", "block", "part")), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets)))], ["id", "block", "part", "set"])

    asked = df.select(F.col(row).alias("row"), F.col(text).alias("_text"))
    asked = asked.join(F.broadcast(members) if members.count() <= MOST_BROADCAST else members, "row").select("id", "block", "part", "_text")
    return asked.mapInArrow(run, "id long, block long, part long, set array<long>")


def histograms(sets: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """How many of each set's hashes lie in each of 256 parts."""
    counts = np.zeros((len(sets), 256), np.uint16 if n.max(initial=0) < 65536 else np.uint32)
    for i, s in enumerate(sets):
        counts[i] = np.bincount((s.view(np.uint64) >> np.uint64(56)).astype(np.int64), minlength=256)
    return counts


def possible(i: int, some: np.ndarray, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which of `some` can be similar to i, by sizes and by what two sets can share in each part of the hashes."""
    both = n[some] + n[i]
    near = np.flatnonzero(np.minimum(n[some], n[i]) * (PART + WHOLE) >= both * PART)
    if not len(near):
        return near
    most = np.concatenate([np.minimum(counts[some[near[k : k + 4096]]], counts[i]).sum(axis=1, dtype=np.int64) for k in range(0, len(near), 4096)])
    return near[most * (PART + WHOLE) >= both[near] * PART]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    return len(np.intersect1d(a, b, assume_unique=True)) * (PART + WHOLE) >= (len(a) + len(b)) * PART


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """The component of each sorted set under similarities of PART / WHOLE or more, as the place of its first member. Every pair not linked yet is compared."""
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    counts = histograms(sets, n)
    root, left = np.full(m, -1), np.arange(m)
    while len(left):
        first, queue = left[0], [left[0]]
        root[first], left = first, left[1:]
        while queue and len(left):
            i = queue.pop()
            near = [k for k in possible(i, left, n, counts).tolist() if similar(sets[i], sets[left[k]])]
            if near:
                root[left[near]] = first
                queue += left[near].tolist()
                left = np.delete(left, near)
    return root


def bridges(sets: list[np.ndarray], group: np.ndarray, asked: np.ndarray) -> list[tuple[int, int]]:
    """Places (i, j) of similar sets of different groups, i an asked one; groups that a bridge joins are not compared again."""
    n = np.array([len(s) for s in sets], np.int64)
    counts, group, found = histograms(sets, n), group.copy(), []
    for i in np.flatnonzero(asked).tolist():
        others = np.flatnonzero(group != group[i])
        for j in others[possible(i, others, n, counts)].tolist():
            if group[j] != group[i] and similar(sets[i], sets[j]):
                found.append((i, j))
                group[group == group[j]] = group[i]
    return found


def grouped(rows: DataFrame, by: list[str], fields: list[str], act: Callable[..., tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(a, b): the edges that act(ids, sets, *other fields) finds in each group of rows (id, set, other fields)."""
    cells = rows.groupBy(*by).agg(F.collect_list(F.struct("id", "set", *fields)).alias("m")).where("size(m) > 1").select("m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for cell in batch.column(0):
                ids, lists, *more = (cell.values.field(k) for k in range(2 + len(fields)))
                at, flat = np.asarray(lists.offsets), lists.values.to_numpy()
                a, b = act(ids.to_numpy(), [flat[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], *(f.to_numpy(zero_copy_only=False) for f in more))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    spark = rows.sparkSession
    small_batches(spark, 4)
    made = stored(cells.mapInArrow(run, "a long, b long"))
    small_batches(spark)
    return made


def within(ids: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    root = linked(sets)
    own = np.flatnonzero(root != np.arange(len(root)))
    return ids[root[own]], ids[own]


def between(ids: np.ndarray, sets: list[np.ndarray], group: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = np.array(bridges(sets, group, asked), np.int64).reshape(-1, 2)
    return ids[found[:, 0]], ids[found[:, 1]]


def dealt(by: str, salt: str, parts: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), by), F.col(parts)).alias("part")


def across_parts(sets: DataFrame, parts: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b): the edges that link what blocks of several parts (block, parts) hold apart, given those within parts."""
    some = sets.join(F.broadcast(parts) if parts.count() <= MOST_BROADCAST else parts, "block")

    def with_group(edges: DataFrame) -> DataFrame:
        root = components(edges).select(F.col("node").alias("id"), "root")
        return stored(some.join(root, "id", "left").withColumn("group", F.coalesce("root", "id")).drop("root"))

    # one text of each group within a part, dealt anew
    now = with_group(edges)
    heads = now.where("id = group")
    deals = heads.groupBy("block").agg(F.ceil(F.count("*") / PART_TEXTS).alias("deals"))
    edges = edges.union(grouped(heads.join(deals, "block").select("id", "set", "block", dealt("id", "heads", "deals")), ["block", "part"], [], within))
    # what is not in the block's largest group meets all of the block
    now = with_group(edges)
    size = now.groupBy("block", "group").agg(F.count("*").alias("n"))
    largest = size.groupBy("block").agg(F.max(F.struct("n", "group"))["group"].alias("largest"), F.sum("n").alias("all"), F.max("n").alias("most"))
    # half a part of asked texts a slice
    largest = largest.withColumn("slices", F.ceil((F.col("all") - F.col("most")) / (PART_TEXTS // 2))).where("slices > 0").select("block", "largest", "slices")
    rest = stored(now.join(F.broadcast(largest) if largest.count() <= MOST_BROADCAST else largest, "block"))
    at = F.pmod(F.xxhash64(F.lit("slice"), "id"), F.col("slices"))
    asks = F.col("group") != F.col("largest")
    shown = rest.select("id", "set", "group", F.lit(False).alias("asked"), "block", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    asking = rest.where(asks).select("id", "set", "group", F.lit(True).alias("asked"), "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), at.alias("slice"))
    return edges.union(grouped(shown.unionByName(asking), ["block", "part", "slice"], ["group", "asked"], between))


def near_classes(docs: DataFrame, keep: list[str], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(docs' columns `keep` with fp, classes (fp, root)): equal roots mean linked by a chain. Texts without a link have no class.

    The last of `keep` is equal only for equal rows; of exact copies one row's text goes to the blocks. Texts without a word
    (null and empty ones too) are copies of each other. No rows: no rows.
    """
    made = stored(with_fingerprints(docs, keep, text))
    texts = made.where("n > 0").groupBy("fp").agg(F.min(keep[-1]).alias("row"), F.first("bits").alias("bits"), F.first("keys").alias("keys"), F.max("n").alias("n"))
    texts = stored(texts.withColumn("id", F.monotonically_increasing_id()))
    met = candidates(texts)
    keyed = texts.select("id", F.explode("keys").alias("key"))
    # only bands of several texts come back to the texts, each as its least text: no list of a band's texts is made
    least = stored(keyed.groupBy("key").agg(F.min("id").alias("m"), F.count("*").alias("n")).where("n > 1").select("key", "m"))
    edges = keyed.join(F.broadcast(least) if least.count() <= MOST_BROADCAST else least, "key").where("id <> m").select(F.col("m").alias("a"), F.col("id").alias("b"))
    edges = met.union(edges).distinct()
    blocks = components(edges).select(F.col("node").alias("id"), F.col("root").alias("block")).join(texts.select("id", "row", "n"), "id")
    blocks = stored(blocks)
    parts = blocks.groupBy("block").agg(F.ceil(F.greatest(F.count("*") / PART_TEXTS, F.sum("n") / PART_SHINGLES)).alias("parts"))
    parts = stored(parts)
    members = stored(blocks.join(parts, "block").select("id", "block", dealt("id", "part", "parts"), "row"))
    sets = stored(shingle_sets(docs, text, keep[-1], members))
    # equal rows repeat a text
    sets = sets.dropDuplicates(["id"])
    edges = grouped(sets, ["block", "part"], [], within)
    several = parts.where("parts > 1")
    if several.limit(1).count():
        edges = across_parts(sets, several, edges)
    found = stored(components(edges).select(F.col("node").alias("id"), "root").join(texts.select("id", "fp"), "id"))
    # a class is named by the fp of its root
    roots = found.where("id = root").select("root", F.col("fp").alias("name"))
    return made.drop("n", "bits", "keys"), found.join(roots, "root").select("fp", F.col("name").alias("root"))
