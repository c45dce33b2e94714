"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of words of every item. A document's words stream through it, and the longest match that
ends at each word tells which windows (WINDOW consecutive words of an item, or a whole shorter item) end there and
which items own them. Words that no item has cannot match, so only runs of item words that are long enough are
streamed; a hash table finds those runs, and the words themselves decide.

The automaton is broadcast, of about MAX_ITEM_WORDS words of items; a larger benchmark is dealt into several, and an
item of more words into parts that overlap by a window less a word. Each automaton is built, matched in a pass whose
spans are written, and released before the next, so that driver and executors hold one at a time; the passes' spans are
united. Documents are not shuffled with one automaton.

Edge cases: null and empty texts have no words and are clean; very long texts are streamed a slice at a time; items without words or without an item_id match nothing;
equal items are both named; repeated rows are judged each; with an empty benchmark every document is clean; other
columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from attestry.llm.common import Words, byte_set, in_batches, table, text_slices, written

WINDOW = 13
MAX_ITEM_WORDS = 300_000
#: Digits, a-z (A-Z fold to them) and all bytes of non-ASCII characters; the contract's [^\x00-\x2F\x3A-\x60\x7B-\x7F].
WORD = byte_set((48, 57), (65, 90), (97, 122), (128, 255))
_GAPS = bytes(b if WORD[b] else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_GAPS).lower().split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the items and short items that each state stands for."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW) -> None:
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        paths = []
        for item, words in items:
            state, path = 0, []
            for w in words:
                state = self._extend(state, self.vocabulary.setdefault(w, len(self.vocabulary)))
                path.append(self.vocabulary[w])
            if path:
                paths.append((item, path))
        self._name(paths)
        self.least = min([window, *(len(p) for _, p in paths)])

    def _copy(self, p: int, c: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, c, q)
        new, p = len(self.next), last
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, c, q)
        return new

    def _name(self, paths: list[tuple[int, list[int]]]) -> None:
        owners: list[list[int]] = [[] for _ in self.next]
        ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for item, path in paths:
            state = 0
            for c in path:
                at = state = self.next[state][c]
                while at > 0 and self.length[at] >= self.window and (not owners[at] or owners[at][-1] != item):
                    owners[at].append(item)
                    at = self.link[at]
            if len(path) < self.window:
                ends[state].append((len(path), item))
        self.whole = {}  # state: items that have the window ending there; only states at the window's length matter
        self.at_window, self.short = [0] * len(self.next), [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[s]
            self.at_window[s] = s if self.length[up] < self.window <= self.length[s] else self.at_window[up]
            self.short[s] = (*ends[s], *self.short[up])
            if self.at_window[s] == s:
                self.whole[s] = tuple(owners[s])

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(start, end, items) of each window that occurs in words."""
        state = size = 0
        number, step, link, length = self.vocabulary.get, self.next, self.link, self.length
        for i, w in enumerate(words):
            c = number(w)
            if c is None:
                state = size = 0
                continue
            while state and c not in step[state]:
                state = link[state]
                size = length[state]
            if c in step[state]:
                state, size = step[state][c], size + 1
            if size >= self.window:
                yield i + 1 - self.window, i + 1, self.whole[self.at_window[state]]
            for n, item in self.short[state]:
                if n <= size:
                    yield i + 1 - n, i + 1, (item,)


def _hits(docs: DataFrame, sent: Broadcast) -> DataFrame:
    """key, n_words, spans (start, end in words) and items of every row. docs: key, text. sent: an Automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: Automaton = sent.value
        known = np.zeros(1 << max(16, len(a.vocabulary).bit_length() + 5), bool)
        shift = np.uint64(64 - (len(known).bit_length() - 1))
        for part in text_slices(pa.array([" ".join(w.decode() for w in a.vocabulary)])):
            known[Words(part, WORD).hash >> shift] = True
        for batch in batches:
            counts, spans, items = [], [], []
            for part in text_slices(batch.column(1)):
                w = Words(part, WORD)
                counts.append(w.count)
                own: list[list[tuple[int, int]]] = [[] for _ in range(part.hi - part.lo)]
                named: list[set[int]] = [set() for _ in own]
                first = np.cumsum(w.count) - w.count
                inside = known[w.hash >> shift]
                turns = np.ones(len(inside) + 1, bool)
                turns[1:-1] = (inside[1:] != inside[:-1]) | (w.doc[1:] != w.doc[:-1])
                edge = np.flatnonzero(turns) if len(inside) else np.zeros(1, np.int64)
                long = (np.diff(edge) >= a.least) & inside[edge[:-1]]
                for lo, hi in zip(edge[:-1][long].tolist(), edge[1:][long].tolist(), strict=True):
                    doc = int(w.doc[lo])
                    run_words = [part.data[s:e].tobytes().lower() for s, e in zip(w.start[lo:hi], w.end[lo:hi], strict=True)]
                    shift_by = int(lo - first[doc])
                    for s, e, who in a.matches(run_words):
                        if own[doc] and own[doc][-1][0] <= s + shift_by <= own[doc][-1][1]:
                            own[doc][-1] = (own[doc][-1][0], max(own[doc][-1][1], e + shift_by))
                        else:
                            own[doc].append((s + shift_by, e + shift_by))
                        named[doc].update(who)
                spans += own
                items += [sorted(x) for x in named]
            spans_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array([[{"s": s, "e": e} for s, e in x] for x in spans], spans_type), pa.array(items, pa.list_(pa.int64()))],
                names=["key", "n_words", "spans", "items"],
            )

    span = StructType().add("s", IntegerType()).add("e", IntegerType())
    kind = StructType([docs.schema["key"]]).add("n_words", LongType()).add("spans", ArrayType(span)).add("items", ArrayType(LongType()))
    return in_batches(docs.select("key", "text"), run, kind)


def item_parts(benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """item_id, part and words (spaced) of the items that have any; longer ones in overlapping parts, so that each window is in one."""
    plain = F.translate(F.col("text").cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    words = F.regexp_extract_all(plain, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words.alias("all")).where("item_id IS NOT NULL AND size(all) > 0")
    step = max(max_words, window)
    starts = F.expr(f"sequence(1, greatest(size(all) - {window - 1}, 1), {step})")
    each = items.select("item_id", "all", F.posexplode(starts).alias("part", "at"))
    return each.select("item_id", "part", F.array_join(F.expr(f"slice(all, at, {step + window - 1})"), " ").alias("words"), F.expr(f"least(size(all) - at + 1, {step + window - 1})").alias("n"))


def automata(benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_ITEM_WORDS) -> tuple[int, Iterator[Automaton]]:
    """How many automata the benchmark's words need, and each in turn; the items of one at a time come to the driver."""
    items = item_parts(benchmark, window, max_words)
    n = max(1, -(-(items.agg(F.sum("n")).first()[0] or 0) // max_words))

    def made() -> Iterator[Automaton]:
        for k in range(n):
            own = items.where(F.pmod(F.xxhash64("item_id", "part"), F.lit(n)) == k).orderBy("item_id", "part", "words").collect()
            yield Automaton([(r["item_id"], r["words"].encode().split(b" ")) for r in own], window)

    return n, made()


_COVERED = "cast(size(array_distinct(flatten(transform(spans, x -> sequence(x.s, x.e - 1))))) as long)"


def matched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_ITEM_WORDS, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, spans (in words) and items of every row of docs, and the row itself if carry."""
    own = {"row": F.struct(*(F.col(f"`{c}`") for c in docs.columns))} if carry else {}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(c.alias(k) for k, c in own.items()))
    n, found = automata(benchmark, window, max_words)
    send = docs.sparkSession.sparkContext.broadcast
    if n == 1:
        hits = _hits(rows.select(F.struct("doc_id", *own).alias("key"), "text"), send(next(found)))
        hits = hits.select("key.*", "n_words", "spans", "items")
    else:  # equal rows have equal hits, so doc_id and the text's hash name a row
        keyed = rows.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "text", *own)
        passes = []
        for automaton in found:
            sent = send(automaton)
            passes.append(written(_hits(keyed, sent), "hits"))
            sent.destroy()
        together = (F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ("spans", "items"))
        united = reduce(DataFrame.unionByName, passes).groupBy("key").agg(F.max("n_words").alias("n_words"), *together)
        united = united.select(F.col("key").alias("own"), "n_words", "spans", "items")
        hits = keyed.join(united, F.col("key").eqNullSafe(F.col("own"))).select("key.doc_id", *own, "n_words", "spans", "items")
    return hits.selectExpr("doc_id", *own, "n_words", f"{_COVERED} AS n_hit", "spans", "items")


CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated."""
    return matched(docs, benchmark, carry=True, **options).where(f"NOT ({CONTAMINATED})").select("row.*")


def _without(column: pa.Array, spans: pa.Array) -> list[str]:
    """Texts without the words of their spans and what stands between these."""
    out = []
    for part in text_slices(column):
        w = Words(part, WORD)
        first = np.cumsum(w.count) - w.count
        data, bounds = part.data.tobytes(), part.bounds.tolist()
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            pieces, at = [], a
            for x in sorted(spans[part.lo + i].as_py() or [], key=lambda x: x["s"]):
                pieces.append(data[at : max(at, int(w.start[first[i] + x["s"]]))])
                at = max(at, int(w.end[first[i] + x["e"] - 1]))
            out.append(b"".join([*pieces, data[at:b]]).decode())
    return out


def removed(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All rows of docs; the matched spans are cut out of the texts of contaminated ones."""
    found = matched(docs, benchmark, text_col=text_col, carry=True, **options)
    found = found.select("row", F.when(F.expr(CONTAMINATED), F.col("spans")).alias("spans"))
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = batch.column(0).flatten()
            plain = pa.array(_without(fields[at].cast(pa.string()), batch.column(1)), pa.string())
            fields[at] = pc.if_else(pc.is_null(fields[at]), pa.scalar(None, pa.string()), plain)
            yield pa.RecordBatch.from_arrays(fields, names=names)

    return in_batches(found, run, docs.schema)


def judged(found: DataFrame) -> DataFrame:
    named = F.array_join(F.array_sort(F.expr("transform(items, x -> cast(x as string))")), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), F.expr(CONTAMINATED).alias("contaminated"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(matched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES = {"op8_decontamination": op8_decontamination}
SQL = {
    "op8_decontamination": r"""
WITH folded AS (
  SELECT 'd' AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark WHERE item_id IS NOT NULL
), worded AS (
  SELECT kind, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM folded
), sizes AS (
  SELECT DISTINCT least(len(ws), 13) AS n FROM worded WHERE kind = 'b' AND len(ws) > 0
), item_windows AS (
  SELECT DISTINCT id, least(len(ws), 13) AS n, array_to_string(list_slice(ws, i, i + least(len(ws), 13) - 1), ' ') AS w
  FROM (SELECT id, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM worded WHERE kind = 'b' AND len(ws) > 0)
), doc_windows AS (
  SELECT id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS w
  FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM worded, sizes WHERE kind = 'd' AND len(ws) >= n)
), hits AS (
  SELECT d.id, d.i, d.n, b.id AS item FROM doc_windows d JOIN item_windows b ON d.n = b.n AND d.w = b.w
), covered AS (
  SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY id
), named AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, cast(item AS VARCHAR) AS item FROM hits) GROUP BY id
)
SELECT w.id AS doc_id, cast(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM worded w LEFT JOIN covered c ON w.id = c.id LEFT JOIN named m ON w.id = m.id WHERE kind = 'd'
"""
}
