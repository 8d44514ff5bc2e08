"""Shared pieces: word splitting on Arrow arrays, bounded slices, shared storage, crc folds."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.session import drop, materialised

#: Words are runs of characters other than space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as keep it apart from those taken (in any case) and from each other."""
    seen, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in seen:
            name += "_"
        seen.add(name.lower())
        out.append(name)
    return out


def without(columns: Sequence[str], results: Iterable[str]) -> list[str]:
    """The columns whose names no result has, in any case: a result replaces the column of its name."""
    own = {r.lower() for r in results}
    return [c for c in columns if c.lower() not in own]


#: a table written to the shared folder and read again: lineage is cut, and a lost executor loses no result
stored = materialised


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, so that a Python worker holds little text at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Freed memory of this process goes back to the system: a Python worker that is used again would hold it beside its next task's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def crc_fold(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `most` bytes of text; a longer single text stays whole."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, base + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """(offsets of each text's words, all words). A null text has none."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets, flat = np.asarray(lists.offsets).astype(np.int64), lists.values
    full = pc.binary_length(flat).to_numpy() > 0
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    return offsets, flat


def sum_by(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]]."""
    total = np.concatenate([np.zeros(1, dtype=values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, UTF-8 bytes) of a string array without nulls."""
    _, off, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(off, dtype=wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
