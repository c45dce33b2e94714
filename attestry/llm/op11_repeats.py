"""Repeated passages by difference-cover anchors.

A difference cover of a period has, for every two positions, a shift of less than the period that puts both on cover
positions. So of two equal windows of WINDOW words one shift puts an anchor, ANCHOR = WINDOW - PERIOD + 1 words from a
cover position on, into both: hashing anchors at 3 of 7 positions misses no match. The work goes in three steps:

1. Anchors. Each unit of documents tells its distinct anchor hashes; those that two documents have are shared.
2. Windows. Each shared anchor is extended to the windows around it, and each unit tells these windows' hashes, each with
   the smallest doc_id of the unit that has it. Windows without a shared anchor are in no other document.
3. Words. A window that also starts in a document with a smaller doc_id is repeated, and its words are removed.

What goes through the shuffle is no row for each word: a unit packs its distinct hashes by ranges of the hash space
into sorted arrays, a range's task looks at all units' arrays, and a bit for each hash comes back. A passage that a
third of the documents hold is one hash in each unit, so no task sees a hot key; no pairs are made. Units are runs of
documents of about UNIT_BYTES, written once in buckets by unit, so that the answers meet the texts without shuffling
these. As many ranges are made as spark.sql.shuffle.partitions says, and a task holds a range's hashes in memory.

Anchors are compared by 48 bits of their hash (more only costs work), windows by 96 bits, beside the range.

Edge cases: a null text has no words; empty texts keep the empty text; texts of fewer than WINDOW words lose none; a very
long text is a unit of its own; rows with equal doc_ids aren't before each other, and a null doc_id comes after all
others; a passage that repeats only within its document stays; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import NOT_SPACE, Words, in_batches, mix, powers, shared_dir, table, text_slices, texts, written

WINDOW, PERIOD = 13, 7
#: Bytes of text of a unit; a task holds some twenty times as much, and a worker keeps that while it waits for its next task.
#: Larger ones make fewer and longer arrays; results don't depend on it.
UNIT_BYTES = 4 << 20
_KEEP = np.arange(256, dtype=np.uint8)
_LAST = (1 << 63) - 1
_SECOND = np.uint64(0xA0761D6478BD642F)


@lru_cache(maxsize=8)
def cover(period: int) -> tuple[int, ...]:
    """Positions whose differences are all residues of the period: each next one adds the most differences."""
    found, seen = [0], {0}
    while len(seen) < period:
        new = {x: {d % period for y in found for d in (x - y, y - x)} - seen for x in range(period) if x not in found}
        best = max(new, key=lambda x: (len(new[x]), -x))
        found.append(best)
        seen |= new[best]
    return tuple(sorted(found))


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """unit, doc_id and text, in buckets by unit: runs of rows of about unit_bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for part in text_slices(batch.column(1), min(unit_bytes, 1 << 19)):
                if held and held + len(part.data) > unit_bytes:
                    unit, held = unit + 1, 0
                held += len(part.data)
                own = batch.slice(part.lo, part.hi - part.lo)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.hi - part.lo, unit)), *own.columns], names=["unit", "doc_id", "text"])

    spark = docs.sparkSession
    rows = in_batches(texts(docs, id_col, text_col), run, "unit long, doc_id long, text string")
    name = f"units_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(parts, "unit").option("path", shared_dir(spark, "units")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


class Unit:
    """The documents of a unit: words as hashes, each with its document, and where windows of a length start."""

    def __init__(self, rows: pa.Table) -> None:
        self.ids = np.array([_LAST if i is None else i for i in rows["doc_id"].to_pylist()], np.int64)
        self.nulls = rows["doc_id"].is_null().to_pylist()
        self.texts = rows["text"].combine_chunks()
        hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for part in text_slices(self.texts):
            w = Words(part, NOT_SPACE, _KEEP)
            hashes.append(w.hash)
            docs.append(w.doc + part.lo)
        self.hash, self.doc = np.concatenate(hashes), np.concatenate(docs)
        self.count = np.bincount(self.doc, minlength=len(self.ids))
        self.first = np.cumsum(self.count) - self.count

    def windows(self, start: np.ndarray, size: int, salt: np.uint64 = np.uint64(0)) -> np.ndarray:
        """Hashes of `size` words from each start."""
        forward, inverse = powers(1 << max(16, len(self.hash).bit_length()))
        sums = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum((mix(self.hash ^ salt) if salt else self.hash) * forward[: len(self.hash)], out=sums[1:])
        return mix((sums[start + size] - sums[start]) * inverse[start])

    def anchors(self, window: int, period: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the anchors in texts of at least a window."""
        size, at = window - period + 1, np.arange(len(self.hash)) - self.first[self.doc]
        on = np.zeros(period, bool)
        on[list(cover(period))] = True
        start = np.flatnonzero(on[at % period] & (at + size <= self.count[self.doc]) & (self.count[self.doc] >= window))
        return start, self.windows(start, size)

    def shared(self, answers: np.ndarray, window: int, period: int) -> np.ndarray:
        """Starts of the windows that hold an anchor which other documents have too; answers: for each distinct hash, whether other units have it."""
        start, h = self.anchors(window, period)
        names, which = np.unique(h, return_inverse=True)
        least, most = np.full(len(names), len(self.ids)), np.full(len(names), -1)
        np.minimum.at(least, which, self.doc[start])
        np.maximum.at(most, which, self.doc[start])
        hit = np.zeros(len(self.hash) + 1, np.int64)
        hit[start[(answers | (least < most))[which]] + 1] = 1
        upto = np.cumsum(hit)
        p = np.arange(max(0, len(self.hash) - window + 1))
        p = p[self.doc[p] == self.doc[p + window - 1]]
        return p[upto[p + period] > upto[p]]


class Told(NamedTuple):
    """The distinct windows of a unit that may be repeated, in order: two hashes and the smallest doc_id; and for every such window its start and its place among them."""

    one: np.ndarray
    two: np.ndarray
    least: np.ndarray
    start: np.ndarray
    place: np.ndarray


def _told(unit: Unit, start: np.ndarray, window: int) -> Told:
    one, two = unit.windows(start, window), unit.windows(start, window, _SECOND) & np.uint64(0xFFFFFFFF)
    ids = unit.ids[unit.doc[start]]
    order = np.lexsort((ids, two, one))
    one, two, ids = one[order], two[order], ids[order]
    new = np.ones(len(order), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return Told(one[new], two[new], ids[new], start[order], np.cumsum(new) - 1)


def _ranges(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the ranges of the hash space among sorted hashes."""
    own = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(own, np.arange(parts + 1, dtype=np.uint64))


_ASKED = "part int, unit long, step int, hashes binary, more binary"
_ANSWER = "unit long, step int, part int, n long, bits binary"
_ASKED_TYPE = pa.schema([("part", pa.int32()), ("unit", pa.int64()), ("step", pa.int32()), ("hashes", pa.binary()), ("more", pa.binary())])
_ANSWER_TYPE = pa.schema([("unit", pa.int64()), ("step", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("bits", pa.binary())])


def _answers(asked: pa.Table) -> pa.Table:
    """For each array of a range a bit for each hash: step 1, another unit has it; step 2, another unit has it with a smaller doc_id."""
    step = asked["step"][0].as_py()
    arrays = [np.frombuffer(x.as_py(), np.uint8) for x in asked["hashes"]]
    width = 6 if step == 1 else 12
    sizes = np.array([len(a) // width for a in arrays])
    raw = np.zeros((int(sizes.sum()), 8 if step == 1 else 16), np.uint8)
    raw[:, :width] = np.concatenate(arrays).reshape(-1, width)
    keys = raw.view(np.uint64)
    if step == 1:
        order = np.argsort(keys[:, 0])
        same = keys[order[1:], 0] == keys[order[:-1], 0]
        yes = np.zeros(len(order), bool)
        yes[order[1:]] |= same
        yes[order[:-1]] |= same
    else:
        ids = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in asked["more"]])
        order = np.lexsort((ids, keys[:, 1], keys[:, 0]))
        k = keys[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]).any(axis=1)
        smallest = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        yes = np.zeros(len(order), bool)
        yes[order] = smallest < ids[order]
    bits = [np.packbits(yes[hi - n : hi]).tobytes() for n, hi in zip(sizes, np.cumsum(sizes), strict=True)]
    return pa.Table.from_arrays([asked["unit"], asked["step"], asked["part"], pa.array(sizes), pa.array(bits, pa.binary())], schema=_ANSWER_TYPE)


def _bits(answers: pa.Table, step: int) -> np.ndarray:
    """The answers of a step in the order of the unit's distinct hashes."""
    rows = sorted((r for r in answers.to_pylist() if r["step"] == step), key=lambda r: r["part"])
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]).astype(bool) for r in rows)])


def _asked(unit: int, step: int, parts: int, ordered: np.ndarray, packed: np.ndarray, more: np.ndarray | None = None) -> pa.Table:
    bounds = _ranges(ordered, parts)
    own = [(k, lo, hi) for k, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if lo < hi]
    rows = [{"part": k, "unit": unit, "step": step, "hashes": packed[lo:hi].tobytes(), "more": None if more is None else more[lo:hi].tobytes()} for k, lo, hi in own]
    return pa.Table.from_pylist(rows, _ASKED_TYPE)


def repeated(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, id_col: str = "doc_id", text_col: str = "text", unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, spans (start, end in words) of what smaller documents hold too, and kept (the other words, joined by a space), of every row."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = units(docs, id_col, text_col, unit_bytes)
    key = lambda t: t["unit"][0].as_py()

    def anchored(group: pa.Table) -> pa.Table:
        names = np.unique(Unit(group).anchors(window, period)[1])
        return _asked(key(group), 1, parts, names, names.view(np.uint8).reshape(-1, 8)[:, :6])

    def extended(group: pa.Table, answers: pa.Table) -> pa.Table:
        unit = Unit(group)
        told = _told(unit, unit.shared(_bits(answers, 1), window, period), window)
        packed = np.concatenate([told.one.view(np.uint8).reshape(-1, 8), told.two.view(np.uint8).reshape(-1, 8)[:, :4]], axis=1)
        return _asked(key(group), 2, parts, told.one, packed, told.least)

    def cut(group: pa.Table, answers: pa.Table) -> pa.Table:
        unit = Unit(group)
        told = _told(unit, unit.shared(_bits(answers, 1), window, period), window)
        again = told.start[_bits(answers, 2)[told.place] | (unit.ids[unit.doc[told.start]] > told.least[told.place])]
        change = np.zeros(len(unit.hash) + 1, np.int64)
        np.add.at(change, again, 1)
        np.add.at(change, again + window, -1)
        gone = np.cumsum(change[:-1]) > 0
        n_gone = np.bincount(unit.doc[gone], minlength=len(unit.ids))
        kept, spans = [], []
        for text, lo, n, lost in zip(unit.texts, unit.first.tolist(), unit.count.tolist(), n_gone.tolist(), strict=True):
            words, own = (text.as_py() or "").encode().split(), gone[lo : lo + n]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))).tolist() if lost else []
            spans.append([{"s": s, "e": e} for s, e in zip(edges[::2], edges[1::2], strict=True)])
            kept.append(b" ".join(compress(words, (~own).tolist()) if lost else words).decode())
        ids = pa.array(unit.ids, mask=np.array(unit.nulls, bool))
        return pa.Table.from_arrays([ids, pa.array(unit.count, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    def asked_with(answers: DataFrame, run, schema: str) -> DataFrame:
        return rows.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(run, schema)

    def answered(asked: DataFrame) -> DataFrame:
        return written(asked.groupBy("part").applyInArrow(_answers, _ANSWER), "repeats")

    one = answered(rows.groupBy("unit").applyInArrow(anchored, _ASKED))
    two = answered(asked_with(one, extended, _ASKED))
    return asked_with(one.unionByName(two), cut, "doc_id long, n_words long, n_removed long, spans array<struct<s:int,e:int>>, kept string")


_SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op11_repeats": op11_repeats}
SQL = {
    "op11_repeats": r"""
WITH worded AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM worded WHERE len(ws) >= 13)
), earliest AS (
  SELECT w, min(doc_id) AS first_id FROM windows GROUP BY w
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT d.doc_id, unnest(range(d.i, d.i + 13)) AS p FROM windows d JOIN earliest e ON d.w = e.w AND e.first_id < d.doc_id) GROUP BY doc_id
), placed AS (
  SELECT w.doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM worded w
), kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.p) AS kept, count(*) AS n FROM placed p LEFT JOIN (SELECT doc_id, unnest(ps) AS p FROM gone) g ON g.doc_id = p.doc_id AND g.p = p.p WHERE g.p IS NULL GROUP BY p.doc_id
)
SELECT w.doc_id, cast(len(ws) AS BIGINT) AS n_words, cast(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM worded w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""
}
