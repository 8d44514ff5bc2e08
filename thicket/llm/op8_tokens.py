"""Token counts by a separator scan over flat token files.

A flat file is a run of little-endian token ids in which an end-of-document id follows each document; there is no index.
Files are read by byte ranges, or kept as a table of blocks of equal size: (file, block, data) either way, so that blocks are
read in parallel. Each block is searched for the separator at once; a document that runs over blocks is stitched by a prefix
scan in two levels over one small row a block: within ranges of blocks, and over the ranges.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.llm.common import slices, small_batches, stored, table

END = 50256
BLOCK_BYTES = 1 << 20


def written(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", end: int = END, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, data, doc_ids): each partition's texts as one flat file of ids of `width` bytes, in blocks; the last may be shorter.

    doc_ids are the ids of the documents that end in the block, in order: a list of names beside the file, of no use for
    its counts. A null or empty text is the end alone. The separator's own string in a text is ordinary text. Block bytes must
    be a multiple of width; an id that does not fit the width is an error. Other columns are not read.
    """
    from thicket.llm.op4_packing import encoder

    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file = encoder(tokenizer).plain, TaskContext.get().partitionId()
        last = np.array([end], "<u4").tobytes()
        # what is not yet cut, the place of its first byte in the file, and where documents end whose names are due
        held, base, ids, ends, block = bytearray(), 0, [], [], 0
        arrow_kind = pa.int64()

        def cut(data: bytes, upto: int) -> pa.RecordBatch:
            nonlocal block
            most = bisect.bisect_right(ends, upto)
            own = pa.ListArray.from_arrays(pa.array([0, most], pa.int32()), pa.array(ids[:most], arrow_kind))
            del ids[:most], ends[:most]
            block += 1
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block - 1], pa.int64()), pa.array([data], pa.binary()), own], ["file", "block", "data", "doc_ids"])

        for batch in slices(batches, "_text"):
            arrow_kind = batch.column("_id").type
            for i, t in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                x = np.frombuffer(encode(t or "") + last, "<u4")
                if width < 4 and int(x.max()) >> 8 * width:
                    raise ValueError(f"token id {int(x.max())} needs more than {width} bytes")
                held += x.astype(f"<u{width}").tobytes()
                ids.append(i)
                ends.append(base + len(held))
                at = 0
                while len(held) - at >= block_bytes:
                    yield cut(bytes(held[at : at + block_bytes]), base + at + block_bytes)
                    at += block_bytes
                del held[:at]
                base += at
        if held:
            yield cut(bytes(held), base + len(held))

    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, f"file int, block long, data binary, doc_ids array<{kind.simpleString()}>")


def ranges(spark: SparkSession, paths: str | list[str], width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, data) of real flat files: each task reads byte ranges, and no file is read as a whole.

    Spark lists the files (a path, a glob or a folder) with their lengths; file is the path. Workers open them by pyarrow's
    file systems, so a path may be local to all workers or remote. An empty file has no block; a file that ends within an id is
    an error.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {block_bytes}"))).alias("block")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = files.where("length > 0").select(F.col("path").alias("file"), "length", block).repartition(parts)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file, length, n in zip(*(batch.column(k).to_pylist() for k in ("file", "length", "block")), strict=True):
                if length % width:
                    raise ValueError(f"{file} does not hold whole ids of {width} bytes")
                system, path = fs.FileSystem.from_uri(file if "://" in file else file.replace(":/", ":///", 1) if ":/" in file else f"file://{file}")
                with system.open_input_file(path) as f:
                    f.seek(n * block_bytes)
                    data = f.read(min(block_bytes, length - n * block_bytes))
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["file", "block", "data"])

    return asked.mapInArrow(read, "file string, block long, data binary")


def scan(blocks: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """(file, block, lengths, head, tail, total): ids before the block's first separator, between its separators, and after the last.

    lengths holds the lengths of the documents that both begin and end in the block, separators not counted. Without a
    separator head and tail are null. Null data is an empty block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column("data").to_pylist():
                x = np.frombuffer(raw or b"", f"<u{width}")
                at = np.flatnonzero(x == end)
                out.append((np.diff(at) - 1, int(at[0]) if len(at) else None, len(x) - int(at[-1]) - 1 if len(at) else None, len(x)))
            bounds = np.cumsum([0, *(len(a) for a, *_ in out)]).astype(np.int32)
            lengths = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([a for a, *_ in out]) if out else np.empty(0, np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), lengths, *(pa.array([o[i] for o in out], pa.int64()) for i in (1, 2, 3))], ["file", "block", "lengths", "head", "tail", "total"])

    kind = blocks.schema["file"].dataType.simpleString()
    return blocks.select("file", "block", "data").mapInArrow(run, f"file {kind}, block long, lengths array<long>, head long, tail long, total long")


def carried(seen: DataFrame) -> DataFrame:
    """(file, block, carry, open): the ids before each block that belong to the document it begins in; open as in counts.

    Rows of (file, block, head, tail, total) are sorted into ranges, each of which runs through its blocks once. What a range does
    not know is what comes in from before it, up to its first separator in a file; one row a file and range goes through the
    second scan, and comes back to those blocks.
    """
    kind = seen.schema["file"].dataType.simpleString()
    parts = int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = seen.select("file", "block", "head", "tail", "total").repartitionByRange(parts, "file", "block").sortWithinPartitions("file", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, at, sum_, known = TaskContext.get().partitionId(), None, 0, False
        for batch in batches:
            files, head, tail, total = (batch.column(k).to_pylist() for k in ("file", "head", "tail", "total"))
            carry, first, after, cut = [], [], [], []
            for f, h, t, n in zip(files, head, tail, total, strict=True):
                if f != at or at is None and not carry:
                    at, sum_, known = f, 0, False
                carry.append(sum_)
                first.append(not known)
                sum_, known = (t, True) if h is not None else (sum_ + n, known)
                after.append(sum_)
                cut.append(known)
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array([pid] * len(carry), pa.int32()), pa.array(carry, pa.int64()), pa.array(first), pa.array(after, pa.int64()), pa.array(cut)], ["file", "block", "p", "carry", "first", "after", "cut"])

    linked = stored(small.mapInArrow(run, f"file {kind}, block long, p int, carry long, first boolean, after long, cut boolean"))
    # a range's last block of a file says what it hands on, and whether that is all there is of the open document
    ends = linked.groupBy("file", "p").agg(F.max(F.struct("block", "after", "cut")).alias("e")).select("file", "p", "e.*")
    order = Window.partitionBy("file").orderBy("p")
    run_ = ends.withColumn("run", F.sum(F.col("cut").cast("int")).over(order))
    upto = F.sum("after").over(Window.partitionBy("file", "run").orderBy("p"))
    handed = run_.withColumn("upto", upto).withColumn("into", F.coalesce(F.lag("upto").over(order), F.lit(0)))
    handed = handed.withColumn("last", F.lead("p").over(order).isNull()).select("file", "p", "into", F.when(F.col("last"), F.col("block")).alias("end"))
    whole = linked.join(handed, ["file", "p"])
    into = F.when(F.col("first"), F.col("into")).otherwise(0)
    left = F.when(F.col("block") == F.col("end"), F.col("after") + F.when(~F.col("cut"), F.col("into")).otherwise(0))
    return whole.select("file", "block", (F.col("carry") + into).alias("carry"), left.alias("open"))




def counts(blocks: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """(file, block, lengths, open): the lengths of the documents that end in each block, in order, those from earlier blocks stitched on.

    open is null but in a file's last block, where it is the length of what follows the last separator, 0 or more. Blocks
    of a file are in the order of `block`, with or without gaps; file is not null. No blocks: no rows. Other columns are not read.
    """
    seen = stored(scan(blocks, end, width))
    own = seen.select("file", "block", "head", "lengths").join(carried(seen), ["file", "block"])
    lengths = F.when(F.col("head").isNull(), F.array().cast("array<long>")).otherwise(F.concat(F.array(F.col("carry") + F.col("head")), "lengths"))
    return own.select("file", "block", lengths.alias("lengths"), "open")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, file, nth): the tokens of every document, its separator not counted, as the scan finds them in flat files of all documents."""
    import public_tokenizers

    small_batches(spark)
    blocks = stored(written(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
    found = counts(blocks).join(blocks.select("file", "block", "doc_ids"), ["file", "block"])
    rows = found.select("file", "block", F.posexplode(F.arrays_zip("lengths", "doc_ids")).alias("nth", "d"))
    return rows.select(F.col("d.doc_ids").alias("doc_id"), F.col("d.lengths").alias("n_tokens"), "file", "block", "nth")
