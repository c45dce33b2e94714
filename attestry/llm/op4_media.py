"""Media columns in content-defined chunks.

A text's bytes, zero-padded to a multiple of 64, are 8-bit samples. A rolling gear hash over the last 32 bytes cuts them
into chunks, so that shared passages give equal chunks wherever they stand. A chunk is named by its SHA-256. Chunks
that occur once stay in their media row; chunks that may occur more often go to a chunk table, deduplicated by digest,
and the row's ordered chunk list points there. Reading joins the lists with the chunks and verifies every digest.

The stored form of a text is its media row's `form`: a manifest of its chunks' digests and sizes, and the bytes of the
chunks that the row holds itself. That is what media_bytes and media_sha256 describe, as read back.

Which chunks may be shared is told by a bit set over the chunks that occur twice: BITS_EACH bits for each of them, within
LEAST_BITS and MOST_BITS (32 MB to the driver and in the broadcast, whatever the corpus size). A false positive only
sends a lone chunk to the chunk table, and nothing shared is missed. So whole payloads are not shuffled, only the shared
chunks and the rows that use them; beyond some 10^8 repeated chunks the set is full, and all chunks go through the
shuffle. Texts are cut twice, to count chunks by a fast hash and to store them, and digested once. A chunk of boilerplate
that one in a thousand references names is broadcast (a thousand of MOST bytes at most), the others are shuffled.

Edge cases: null and empty texts are 64 zero bytes; a very long text is many chunks of one row; repeated rows share all
chunks and are returned each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import in_batches, joined_by, mix, table, text_slices, texts, written

UNIT = 64
#: Smallest and largest chunk; a cut is where the lowest MASK_BITS of the gear hash are zero.
LEAST, MOST, MASK_BITS = 1024, 16384, 12
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 16, 28
_BLOCK = 15  # bits of a slot within a block of the bit set
_MAGIC, _ENTRY, _INSIDE = b"CDC2", np.dtype([("digest", "V32"), ("size", "<u4")]), 1 << 31
#: A random number for each byte value, from a counter.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def cut_candidates(data: np.ndarray) -> np.ndarray:
    """Ends of the bytes at which the gear hash h = 2 h + GEAR[byte] mod 2^32 has zero low bits; h forgets all but 32 bytes."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):  # sums over 2, 4 ... 32 bytes by doubling
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return np.flatnonzero((h & np.uint32((1 << MASK_BITS) - 1)) == 0) + 1


def cuts(candidates: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of the bytes from start to end."""
    out = []
    while end - start > LEAST:
        k = np.searchsorted(candidates, start + LEAST)
        start = min(int(candidates[k]) if k < len(candidates) else end, start + MOST, end)
        out.append(start)
    if not out or out[-1] < end:
        out.append(end)
    return out


def chunked(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Row number, unpadded size and chunks of each text; padding belongs to the last chunk."""
    for part in text_slices(column):
        data, bounds, candidates = part.data.tobytes(), part.bounds.tolist(), cut_candidates(part.data)
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            ends = cuts(candidates, a, b)
            chunks = [data[x:y] for x, y in zip([a, *ends], ends)]
            chunks[-1] += bytes(max(UNIT, -(-(b - a) // UNIT) * UNIT) - (b - a))
            yield part.lo + i, b - a, chunks


def _name(chunk: bytes) -> int:
    return xxhash.xxh3_64_intdigest(chunk) - (1 << 63)


def packed_form(n_bytes: int, digests: list[bytes], sizes: list[int], inside: list[bool], own: bytes) -> bytes:
    """The stored form of a text: magic, its size without padding, number of chunks, digest and size of each (the top bit tells those held here), and these chunks."""
    table_ = np.zeros(len(sizes), _ENTRY)
    table_["digest"] = np.frombuffer(b"".join(digests), "V32")
    table_["size"] = np.array(sizes, np.int64) | np.where(inside, _INSIDE, 0)
    return b"".join([_MAGIC, n_bytes.to_bytes(8, "little"), len(sizes).to_bytes(4, "little"), table_.tobytes(), own])


class Store(NamedTuple):
    media: DataFrame  # row, doc_id, form, refs (digests of the chunks that aren't in form, in order)
    chunks: DataFrame  # digest, data


def _shared_bits(rows: DataFrame) -> tuple[bytes, int]:
    """The bit set of the chunks that occur twice, and the bits of a slot in it."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_name(c) for _, _, cs in chunked(batch.column(1)) for c in cs], pa.int64())], names=["name"])

    twice = written(in_batches(rows, names, "name long").groupBy("name").count().where("count > 1").select("name"), "media-twice")
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * twice.count()).bit_length()))

    def block(group: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(1 << _BLOCK, bool)
        out[group["slot"].to_numpy() & ((1 << _BLOCK) - 1)] = True
        return pd.DataFrame({"block": [int(group["slot"].iloc[0]) >> _BLOCK], "bits": [np.packbits(out, bitorder="little").tobytes()]})

    slots = twice.select(F.col("name").bitwiseAND((1 << bits) - 1).alias("slot")).distinct()
    found = slots.groupBy(F.shiftright("slot", _BLOCK)).applyInPandas(block, "block long, bits binary").collect()  # 2^13 blocks of 4 KB at most
    whole = bytearray(1 << (bits - 3))
    for r in found:
        at = r["block"] << (_BLOCK - 3)
        whole[at : at + len(r["bits"])] = r["bits"]
    return bytes(whole), bits


def write(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Store:
    """The media rows and the shared chunks, as tables in the shared folder."""
    rows = texts(docs, id_col, text_col)
    whole, bits = _shared_bits(rows)
    sent = docs.sparkSession.sparkContext.broadcast(whole)  # 2^(MOST_BITS - 3) bytes at most

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = sent.value, TaskContext.get().partitionId() << 36

        def shared(chunk: bytes) -> bool:
            slot = _name(chunk) & ((1 << bits) - 1)
            return bool(known[slot >> 3] >> (slot & 7) & 1)

        for batch in batches:
            ids, out, pieces = batch.column(0).to_pylist(), [], {}
            for i, size, chunks in chunked(batch.column(1)):
                digests = [hashlib.sha256(c).digest() for c in chunks]
                inside = [not shared(c) for c in chunks]
                own = b"".join(c for c, x in zip(chunks, inside, strict=True) if x)
                refs = [d for d, x in zip(digests, inside, strict=True) if not x]
                pieces.update((d, c) for d, c, x in zip(digests, chunks, inside, strict=True) if not x)
                out.append({"kind": "media", "row": row, "doc_id": ids[i], "form": packed_form(size, digests, [len(c) for c in chunks], inside, own), "refs": refs})
                row += 1
            yield pa.RecordBatch.from_pylist(out, _STORED)
            yield pa.RecordBatch.from_pylist([{"kind": "chunk", "form": c, "refs": [d]} for d, c in pieces.items()], _STORED)

    made = written(in_batches(rows, stored, "kind string, row long, doc_id long, form binary, refs array<binary>"), "media", partition_by=("kind",))
    media = made.where("kind = 'media'").drop("kind")
    chunks = made.where("kind = 'chunk'").groupBy(F.col("refs")[0].alias("digest")).agg(F.any_value("form").alias("data"))
    return Store(media, written(chunks, "media-chunks"))


_STORED = pa.schema([("kind", pa.string()), ("row", pa.int64()), ("doc_id", pa.int64()), ("form", pa.binary()), ("refs", pa.list_(pa.binary()))])


def read(store: Store) -> DataFrame:
    """doc_id, form and the chunks that the form does not hold itself, in order."""
    using = store.media.where("size(refs) > 0")
    refs = written(using.select("row", F.posexplode("refs").alias("pos", "digest")), "media-refs")
    found = joined_by(refs, store.chunks, "digest").groupBy("row").agg(F.expr("transform(array_sort(collect_list(struct(pos, data))), x -> x.data)").alias("others"))
    alone = store.media.where("size(refs) = 0").select("doc_id", "form", F.expr("cast(array() AS array<binary>)").alias("others"))
    return alone.unionByName(using.join(found, "row").select("doc_id", "form", "others"))


def reconstructed(form: bytes, others: list[bytes]) -> tuple[int, list[int], bytes]:
    """Size without padding, sizes of the chunks and the payload of a stored form; a chunk that isn't what its digest says, or is missing, is an error."""
    if form[:4] != _MAGIC:
        raise ValueError("not a stored text")
    n_bytes, n = int.from_bytes(form[4:12], "little"), int.from_bytes(form[12:16], "little")
    table_ = np.frombuffer(form, _ENTRY, n, 16)
    sizes, inside = (table_["size"] & (_INSIDE - 1)).tolist(), (table_["size"] >= _INSIDE).tolist()
    out, at, rest = [], 16 + table_.nbytes, iter(others)
    for digest, size, here in zip(table_["digest"].tolist(), sizes, inside, strict=True):
        chunk = form[at : at + size] if here else next(rest, b"")
        at += size if here else 0
        if hashlib.sha256(chunk).digest() != digest:
            raise ValueError(f"chunk {digest.hex()} is not what was stored")
        out.append(chunk)
    return n_bytes, sizes, b"".join(out)


def feature(payload: bytes) -> str:
    """Mean, deviation, mean step and a 16-bin histogram per mille of the samples."""
    x = np.frombuffer(payload, np.uint8)
    step = np.abs(np.diff(x.astype(np.int16))).mean() if len(x) > 1 else 0.0
    bins = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    return f"{x.mean():.4f};{x.std():.4f};{step:.4f};" + ",".join(map(str, bins.tolist()))


def described(store: Store) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                form = row["form"]
                n_bytes, sizes, payload = reconstructed(form, row["others"])
                out.append({
                    "doc_id": row["doc_id"], "n_bytes": n_bytes, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
                    "tail_crc32": zlib.crc32(payload[-UNIT:]), "media_bytes": len(form), "media_sha256": hashlib.sha256(form).hexdigest(),
                    "feature": feature(payload), "n_chunks": len(sizes),
                })
            yield pa.RecordBatch.from_pylist(out, _DESCRIBED)

    return in_batches(read(store), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long")


_DESCRIBED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_chunks", pa.int64())])


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(write(table(spark, sf_dir, "documents")))


QUERIES = {"op4_media": op4_media}
SQL: dict[str, str] = {}
