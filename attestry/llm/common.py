"""What the training-data operators share: tables, the shared folder and byte-level word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that the numpy helpers work on at once; a longer document is worked on alone.
SLICE_BYTES = 1 << 19
#: Documents that are sent to Python at once.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that text operators read, a null text as the empty one, under names of their own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="attestry-")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder under spark.checkpoint.dir. Where that is unset a temporary one, on a local master alone: executors elsewhere would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return f"{(root or _own_dir()).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def in_batches(rows: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """rows.mapInArrow for rows that hold whole texts: at most BATCH_ROWS of them are in memory at once, on either side."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return rows.mapInArrow(run, schema)


def written(df: DataFrame, tag: str, codec: str = "zstd", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and a lost executor costs no recomputation."""
    path = shared_dir(df.sparkSession, tag)
    df.write.option("compression", codec).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined_by(rows: DataFrame, keyed: DataFrame, key: str, least: int = 512, most: int = 1000) -> DataFrame:
    """rows.join(keyed, key), where one key may hold a third of the rows and keyed has one row for each key.

    Keys that hold more than one in `most` of the rows are `most` at most: their rows of keyed are broadcast, and only
    the others are shuffled. rows is read several times, so it should be a written table.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    hot = written(counts.where(F.col("_n") > max(least, rows.count() // most)).select(key), "hot")
    if hot.isEmpty():
        return rows.join(keyed, key)
    ahead = keyed.join(F.broadcast(hot), key, "left_semi")
    return rows.join(F.broadcast(ahead), key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(keyed, key))


class Slice(NamedTuple):
    """Some documents of an Arrow batch: rows lo to hi, their bytes and each one's bounds in them."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """A string column in runs of rows of about limit bytes, without copies."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield Slice(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry membership table."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: A-Z to a-z, other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Letters, digits and every byte of a non-ASCII character.
ALNUM = byte_set((48, 57), (65, 90), (97, 122), (128, 255))
#: All but ASCII white space.
NOT_SPACE = ~byte_set((9, 13), (32, 32))

_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    out = []
    for base in (_ODD, _ODD_INVERSE):
        a = np.full(n + 1, base, np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all their bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def word_bounds(data: np.ndarray, bounds: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the maximal runs of given bytes within a document."""
    n = len(data)
    inside = member[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[bounds[:-1][bounds[:-1] < n]] = False
        after[bounds[1:][bounds[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    return start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(bounds, start, "right") - 1


class Words:
    """The words of a slice (maximal runs of given bytes within a document): where they are and their hashes."""

    def __init__(self, part: Slice, member: np.ndarray, fold: np.ndarray = FOLD) -> None:
        n, bounds = len(part.data), part.bounds
        self.start, self.end, self.doc = word_bounds(part.data, bounds, member)
        self.n_docs = len(bounds) - 1
        self.count = np.bincount(self.doc, minlength=self.n_docs)
        size = 1 << max(16, int(n).bit_length())
        forward, self._inverse = powers(size)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((fold[part.data].astype(np.uint64) + np.uint64(1)) * forward[:n], out=self._sums[1:])
        self.hash = self.between(self.start, self.end)

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte runs from start to end, equal for equal runs wherever they are."""
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start])
