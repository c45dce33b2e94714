"""Phrase collocations by suffix-sigma.

Each word of a piece is the head of a suffix, cut after max_n words. Equal suffixes are counted within a task, FLUSH words at a
time, and written as one key: language, first word, following words. The keys are shuffled in ranges of language and first
word; a first word that many suffixes share is split by the words that follow it, so no word, pair or language makes a
task large. Within a range keys come in reverse lexicographic order, longer suffixes before their prefixes, and one
stack of max_n + 1 open prefixes (the language's own total at its bottom) counts them all; it is kept across Arrow batches,
and within a batch its steps are sums between the places where a prefix ends. A prefix that the edge of a range cuts is
told by both sides and added up. What is counted less than `least` times can be neither a candidate nor a part of one
and is not told. Frequencies of parts are then joined to the candidates; parts that many candidates share are broadcast.

All counts are whole: every word of every text takes part. Products are decimals of 38 digits, exact for counts up to 10^15.

Edge cases: a null text is the empty one and has no words; a null language is `und`; very long texts and words are keys
like others; repeated rows count as often as they occur; equal scores are told apart by count and then by the phrase's
bytes; control characters within words are kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.llm.common import FOLD, byte_set, in_batches, joined_by, table, text_slices, written

MAX_N, LEAST, SHARE, TOP = 3, 10, 50, 2000
#: Words of which a task counts equal suffixes before it tells them.
FLUSH = 1 << 21
_BATCH = 1 << 16
_BREAK = byte_set(*((ord(c), ord(c)) for c in ".,;:!?"), (10, 13))
_WORD = ~(_BREAK | byte_set((9, 9), (32, 32)))
_JOIN, _ESCAPE = "\t", "\n"  # neither is in a word; _JOIN sorts before all that is in a key


def _escaped(column: pa.Array, upto: int) -> pa.Array:
    """Characters up to `upto`, which would sort before _JOIN or end a field, as _ESCAPE and a letter."""
    for c in (ord(_ESCAPE), *(c for c in range(upto + 1) if c != ord(_ESCAPE))):
        column = pc.replace_substring(column, chr(c), _ESCAPE + chr(64 + c))
    return column


def plain(column: Column) -> Column:
    """What _escaped made, as it was."""
    for c in (*(c for c in range(10)), 10):
        column = F.replace(column, F.lit(_ESCAPE + chr(64 + c)), F.lit(chr(c)))
    return column


def _words(column: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """For runs of rows: the first row's number, words with A-Z folded, each one's row, and whether the next one continues its piece."""
    for part in text_slices(column):
        data, bounds = FOLD[part.data], part.bounds
        inside = _WORD[data]
        if not inside.any():
            continue
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[bounds[:-1][bounds[:-1] < len(data)]] = False
        after[bounds[1:][bounds[1:] > 0] - 1] = False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        doc = np.searchsorted(bounds, start, "right") - 1
        breaks = np.cumsum(_BREAK[data])[start]
        on = np.zeros(len(start), bool)
        on[:-1] = (doc[1:] == doc[:-1]) & (breaks[1:] == breaks[:-1])
        offsets = np.zeros(len(start) + 1, np.int32)
        np.cumsum(end - start, out=offsets[1:])
        words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes()))
        yield part.lo, _escaped(words, 8) if (data < 9).any() else words, doc, on


def suffixes(docs: DataFrame, max_n: int = MAX_N, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """key (language and up to max_n words, joined) and n of the suffixes of every text, equal ones of a task together, in order."""
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def counted(langs: list[pa.Array], words: list[pa.Array], on: np.ndarray) -> Iterator[pa.RecordBatch]:
        def coded(arrays: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
            """Distinct values in order, and for each value its place among them."""
            found = pa.concat_arrays(arrays).dictionary_encode()
            order = pc.sort_indices(found.dictionary).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            return found.dictionary.take(pa.array(order)), place[found.indices.to_numpy()]

        (lang_names, lang), (names, code) = coded(langs), coded(words)
        fields, alive = {"lang": lang, "w0": code}, np.ones(len(code), bool)
        for k in range(1, max_n):
            alive = alive & np.concatenate([on[k - 1 :], np.zeros(min(k - 1, len(on)), bool)])
            fields[f"w{k}"] = np.where(alive, np.roll(code, -k), -1)
        same = pa.table(fields).group_by(list(fields), use_threads=False).aggregate([([], "count_all")])
        same = same.sort_by([(f, "ascending") for f in fields])
        for lo in range(0, same.num_rows, _BATCH):
            part = same.slice(lo, _BATCH)
            shown = [lang_names.take(part["lang"].combine_chunks())]
            for k in range(max_n):
                at = part[f"w{k}"].to_numpy()
                shown.append(names.take(pa.array(at, pa.int64(), mask=at < 0)))
            key = pc.binary_join_element_wise(*shown, _JOIN, null_handling="skip")
            yield pa.RecordBatch.from_arrays([key, part["count_all"].combine_chunks().cast(pa.int64())], names=["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, words, ons, held = [], [], [], 0
        for batch in batches:
            lang = _escaped(batch.column(0), 10)
            for lo, found, doc, on in _words(batch.column(1)):
                langs.append(lang.take(pa.array(doc + lo)))
                words.append(found)
                ons.append(on)
                held += len(found)
                if held >= FLUSH:
                    yield from counted(langs, words, np.concatenate(ons))
                    langs, words, ons, held = [], [], [], 0
        if held:
            yield from counted(langs, words, np.concatenate(ons))

    return in_batches(rows, run, "key string, n long")


def _prefix_counts(least: int, max_n: int):
    """The stack over keys in descending order: emits (lang, phrase, k, f) of prefixes as they close."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: list[tuple[str, int] | None] = [None] * (max_n + 1)  # the stack: by depth the open prefix and its count
        edge = [True] * (max_n + 1)  # whether the open prefix began with the range, so that another may hold more of it
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, n = batch.column(0), batch.column(1).to_numpy()
            fields = pc.split_pattern(keys, _JOIN)
            size = pc.list_value_length(fields).to_numpy()
            first = np.cumsum(size) - size
            codes = fields.flatten().dictionary_encode().indices.to_numpy()
            changed = np.zeros(len(n), bool)
            changed[0] = True
            names, depths, counts = [], [], []
            for depth in range(max_n + 1):
                here = np.full(len(n), -1)
                here[size > depth] = codes[first[size > depth] + depth]
                changed = changed | np.concatenate([[True], here[1:] != here[:-1]])
                starts = np.flatnonzero(changed)
                sums = np.add.reduceat(n, starts)
                real = size[starts] > depth
                starts, sums = starts[real], sums[real]
                if not len(starts):
                    continue
                shown = lambda rows: pc.binary_join(pc.list_slice(fields.take(pa.array(rows)), 0, depth + 1), _JOIN).to_pylist()  # noqa: B023, E731
                ends = shown(starts[[0, -1]])
                tell = np.ones(len(sums), bool) if depth == 0 else sums >= least
                if opened[depth] is not None and opened[depth][0] == ends[0]:
                    sums[0] += opened[depth][1]
                    tell[0] = depth == 0 or edge[depth] or sums[0] >= least
                elif opened[depth] is not None:
                    if depth == 0 or edge[depth] or opened[depth][1] >= least:
                        names.append(opened[depth][0])
                        depths.append(depth)
                        counts.append(opened[depth][1])
                    edge[depth] = False
                else:
                    tell[0] = True
                opened[depth] = (ends[1], int(sums[-1]))
                edge[depth] = edge[depth] and len(sums) == 1
                tell[-1] = False
                told = np.flatnonzero(tell)
                if len(told):
                    names += shown(starts[told])
                    depths += [depth] * len(told)
                    counts += sums[told].tolist()
            if names:
                yield _told(names, depths, counts)
        left = [(o, d) for d, o in enumerate(opened) if o is not None]
        if left:
            yield _told([o[0] for o, _ in left], [d for _, d in left], [o[1] for o, _ in left])

    def _told(names: list[str], depths: list[int], counts: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(depths, pa.int32()), pa.array(counts, pa.int64())], names=["key", "k", "f"])

    return run


def frequencies(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, phrase (words joined by a space), k (its words) and f of all phrases of up to max_n words that occur `least` times; with k = 0 each language's words."""
    keyed = written(suffixes(docs, max_n, lang_col, text_col), "suffixes")
    ranges = keyed.repartitionByRange(F.desc("key")).sortWithinPartitions(F.desc("key"))
    told = ranges.mapInArrow(_prefix_counts(least, max_n), "key string, k int, f long")
    sums = told.groupBy("key", "k").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("k") == 0))
    parts = F.split("key", _JOIN, 2)
    phrase = F.replace(F.coalesce(F.get(parts, 1), F.lit("")), F.lit(_JOIN), F.lit(" "))
    return sums.select(plain(F.get(parts, 0)).alias("lang"), plain(phrase).alias("phrase"), "k", "f")


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, share: int = SHARE, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, phrase, a, l, r, n and score of every candidate that no longer one holds in `share` per cent of its places."""
    counts = written(frequencies(docs, max_n, least, lang_col, text_col), "phrases")
    words, of = F.split("phrase", " "), lambda ws, at, size: F.array_join(F.slice(ws, at, size), " ")
    candidates = counts.where("k >= 2").select("lang", "phrase", words.alias("ws"), "k", F.col("f").alias("a"))
    cut = candidates.select("lang", "phrase", "ws", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cut = cut.select("lang", "phrase", "a", "at", F.struct("lang", of(F.col("ws"), 1, F.col("at")).alias("phrase")).alias("first"), F.struct("lang", of(F.col("ws"), F.col("at") + 1, F.col("k") - F.col("at")).alias("phrase")).alias("rest"))
    part = F.struct("lang", "phrase")
    cut = written(joined_by(written(cut, "cuts"), counts.where("k >= 1").select(part.alias("first"), F.col("f").alias("l")), "first").drop("first"), "firsts")
    cut = joined_by(cut, counts.where("k >= 1").select(part.alias("rest"), F.col("f").alias("r")), "rest")
    big = lambda c: F.col(c).cast("decimal(20,0)")
    cut = cut.select("lang", "phrase", "a", "at", "l", "r", (F.lit(1_000_000).cast("decimal(7,0)") * (big("a") * big("a"))).alias("dividend"), (big("l") * big("r")).alias("divisor"))
    scored = cut.select("lang", "phrase", "a", F.struct(F.expr("dividend div divisor").alias("score"), "at", "l", "r").alias("cut"))
    scored = scored.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min("cut").alias("cut"))
    inner = candidates.where("k >= 3").select("lang", "ws", "k", "a", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inner = inner.select("lang", "ws", "a", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("at"))
    inner = inner.groupBy("lang", of(F.col("ws"), F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    whole = scored.join(inner, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * cast(longer AS decimal(20,0)) < {int(share)} * cast(a AS decimal(20,0))")
    totals = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return whole.join(totals, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` of each language, with their rank; parts of a language are ranked first, so no task sorts all of it."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = found.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return last.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(collocations(table(spark, sf_dir, "documents")))


QUERIES = {"op12_collocations": op12_collocations}
SQL = {
    "op12_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM documents
), totals AS (
  SELECT lang, cast(sum(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY lang HAVING sum(len(ws)) > 0
), grams AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k)
), counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10
), candidates AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM counts WHERE k >= 2
), cuts AS (
  SELECT lang, phrase, a, c, array_to_string(ws[1:c], ' ') AS head, array_to_string(ws[c + 1:k], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS c FROM candidates)
), scored AS (
  SELECT u.lang, u.phrase, u.a, u.c, x.f AS l, y.f AS r, (cast(1000000 AS HUGEINT) * u.a * u.a) // (cast(x.f AS HUGEINT) * y.f) AS score
  FROM cuts u JOIN counts x ON x.lang = u.lang AND x.phrase = u.head JOIN counts y ON y.lang = u.lang AND y.phrase = u.tail
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), held AS (
  SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM candidates WHERE k = 3) GROUP BY ALL
), kept AS (
  SELECT w.*, t.n FROM lowest w JOIN totals t USING (lang) LEFT JOIN held h ON h.lang = w.lang AND h.phrase = w.phrase WHERE h.longer IS NULL OR 100 * h.longer < 50 * w.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, cast(score AS BIGINT) AS score
FROM kept QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
}
