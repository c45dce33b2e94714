"""Token ids in patched frame-of-reference blocks.

Documents are dealt by ranges of doc_id and sorted; each task encodes its run of them and writes segments of token ids.
A segment is a sequence of blocks of 128 ids: the block's minimum is subtracted, the rest is packed at the width that
holds PERCENTILE of it, what doesn't fit goes to exception lists, and an index holds where each block starts, so that
any block is read alone. Segments are rows of a table in the shared folder with their task's number and their offset
in it; the tasks' totals, one number each, give every document's place in the whole stream.

Words are encoded once for as long as a worker's cache holds them, CACHED_WORDS of at most CACHED_BYTES bytes: the
vocabulary's rules never cross ASCII white space, so a text's ids are its words' ids in a row. Each distinct word of a
slice of texts is looked up once, a mark of punctuation behind a word as a word of its own; ids are then gathered by place.

Edge cases: null and empty texts have the end id alone; a very long text, with or without spaces, is encoded alone and
its long words are kept by no cache; a null doc_id sorts first; equal doc_ids are adjacent, in order
of their texts' hashes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import FOLD, NOT_SPACE, Slice, in_batches, mix, table, text_slices, texts, word_bounds, written

BLOCK, PERCENTILE = 128, 0.9
END_ID = 1
SEGMENT_IDS, CACHED_WORDS, CACHED_BYTES = 1 << 20, 500_000, 64
#: Bytes of text whose distinct words are looked up together.
SLICE_BYTES = 1 << 21
_SEPARATOR, _MAGIC = "<|endoftext|>", b"PFR1"
_PUNCTUATION = string.punctuation.encode()


def pack(values: np.ndarray) -> bytes:
    """Ids below 2^32 as a segment."""
    n = len(values)
    blocks = np.full((-(-n // BLOCK), BLOCK), values[-1] if n else 0, np.uint32)
    blocks.ravel()[:n] = values
    low = blocks.min(1) if n else np.zeros(0, np.uint32)
    rest = blocks - low[:, None]
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)  # bit lengths
    width = np.sort(bits, axis=1)[:, int(np.ceil(PERCENTILE * BLOCK)) - 1] if n else np.zeros(0, np.uint8)
    over = bits > width[:, None]
    exception = np.nonzero(over)
    high = (rest[exception].astype(np.uint64) >> width[exception[0]].astype(np.uint64)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(width.astype(np.int64) * 4)])
    packed = np.zeros(starts[-1], np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        lanes = rest[own].reshape(len(own), 32, 4) & np.uint32((1 << w) - 1)
        words = np.zeros((len(own), w, 4), np.uint32)
        for j in range(32):
            at, shift = divmod(j * w, 32)
            words[:, at] |= lanes[:, j] << np.uint32(shift)
            if shift + w > 32:
                words[:, at + 1] |= lanes[:, j] >> np.uint32(32 - shift)
        packed[(starts[own][:, None] + np.arange(4 * w)).ravel()] = words.ravel()
    head = np.array([n, len(blocks), len(high)], "<u4")
    return b"".join([_MAGIC, head.tobytes(), low.astype("<u4").tobytes(), starts[:-1].astype("<u4").tobytes(), over.sum(1).astype(np.uint8).tobytes(), width.tobytes(), high.astype("<u4").tobytes(), exception[1].astype(np.uint8).tobytes(), packed.astype("<u4").tobytes()])


def unpack(segment: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks first to last (exclusive) of a segment, all of them by default."""
    if segment[:4] != _MAGIC:
        raise ValueError("not a segment of token ids")
    n, m, k = np.frombuffer(segment, "<u4", 3, 4).tolist()
    at = 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(segment, kind, count, at)
        at += out.nbytes
        return out

    low, starts, counts, width, high, place = take("<u4", m), take("<u4", m), take("u1", m), take("u1", m), take("<u4", k), take("u1", k)
    packed = np.frombuffer(segment, "<u4", -1, at)
    first = min(first, m)
    last = m if last is None else max(first, min(last, m))
    rest = np.zeros((last - first, BLOCK), np.uint32)
    for w in np.unique(width[first:last]).tolist():
        if w:
            own = np.flatnonzero(width[first:last] == w)
            words = packed[(starts[first:last][own].astype(np.int64)[:, None] + np.arange(4 * w)).ravel()].reshape(len(own), w, 4)
            lanes = np.empty((len(own), 32, 4), np.uint32)
            for j in range(32):
                at_word, shift = divmod(j * w, 32)
                value = words[:, at_word] >> np.uint32(shift)
                if shift + w > 32:
                    value = value | words[:, at_word + 1] << np.uint32(32 - shift)
                lanes[:, j] = value & np.uint32((1 << w) - 1)
            rest[own] = lanes.reshape(len(own), BLOCK)
    ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    mine = slice(ends[first], ends[last])
    row = np.repeat(np.arange(last - first), counts[first:last])
    rest[row, place[mine]] |= high[mine] << width[first:last][row].astype(np.uint32)
    return (rest + low[first:last, None]).ravel()[: n - first * BLOCK]


class WordEncoder:
    """Ids of texts by whole words, the recent ones from a cache of bounded size. For vocabularies that mark word ends and
    fold case, such as word_bpe_49k: case and closing punctuation are taken off a word before it is looked up."""

    def __init__(self, tokenizer_json: str, cached: int = CACHED_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.separator = self.tokenizer.token_to_id(_SEPARATOR)
        rules = json.loads(tokenizer_json)
        self.ending = (rules["model"].get("end_of_word_suffix") or "") if "Lowercase" in json.dumps(rules.get("normalizer")) else ""
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if self.ending:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(self.ending)]] = True
        self.cached, self.recent, self.older = cached, {}, {}
        self.passing: list[bytes] = []  # words that are too long to keep

    def _keep(self, words: list[bytes], ids: np.ndarray, cuts: list[int], gap: int) -> None:
        raw = ids.astype("<u4").tobytes()
        for w, a, b in zip(words, cuts[:-1], cuts[1:], strict=True):
            self.recent[w] = raw[4 * (a + gap) : 4 * b]

    def _learn_apart(self, words: list[bytes]) -> None:
        """Words of any characters, with a token between them that no word holds."""
        odd = [w for w in words if b"<|" in w or self.separator is None]
        plain = [w for w in words if b"<|" not in w] if self.separator is not None else []
        for i in range(0, len(odd), 1000):
            part = odd[i : i + 1000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                self.recent[w] = np.array(e.ids, "<u4").tobytes()
        for i in range(0, len(plain), 2000):
            part = plain[i : i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([_SEPARATOR.join(w.decode() for w in part)], add_special_tokens=False)[0].ids, "<u4")
            self._keep(part, ids, [-1, *np.flatnonzero(ids == self.separator).tolist(), len(ids)], 1)

    def _learn_letters(self, words: list[bytes]) -> None:
        """Words of letters alone, which end where a token says so."""
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
            if len(cuts) == len(part) + 1:
                self._keep(part, ids, cuts, 0)
            else:
                self._learn_apart(part)

    def _learn(self, words: set[bytes]) -> None:
        if not self.ending:
            self._learn_apart(sorted(words))
            return
        closed: list[tuple[bytes, bytes, bytes]] = []
        pieces: set[bytes] = set()
        for w in words:
            core = w.rstrip(_PUNCTUATION)
            if core != w and core and core[-1:].isalnum() and b"<|" not in w:
                closed.append((w, core, w[len(core) :]))
                pieces.add(core)
                pieces.add(closed[-1][2])
            else:
                pieces.add(w)
        self.passing += [w for w in pieces if len(w) > CACHED_BYTES]
        letters, others = [], []
        for w in pieces:
            if w in self.recent:
                continue
            plain = w.isalpha() if w.isascii() else (text := w.decode()).isalpha() and text == text.lower()
            (letters if plain else others).append(w)
        self._learn_letters(letters)
        self._learn_apart(others)
        recent = self.recent
        recent.update((w, recent[core] + recent[tail]) for w, core, tail in closed)

    def _spoken(self, part: Slice) -> np.ndarray:
        """A slice's bytes as words are looked up: folded, but the name of a special token counts as it is written."""
        if not self.ending:
            return part.data
        out = FOLD[part.data]
        for at in np.flatnonzero((part.data[:-1] == 60) & (part.data[1:] == 124)).tolist() if len(part.data) else ():  # <|
            lo, hi = part.bounds[np.searchsorted(part.bounds, at, "right") - 1 :][:2].tolist()
            if at + 1 < hi:
                space = ~NOT_SPACE[part.data[lo:hi]]
                before, after = np.flatnonzero(space[: at - lo]), np.flatnonzero(space[at - lo :])
                word = slice(lo + int(before[-1]) + 1 if len(before) else lo, at + int(after[0]) if len(after) else hi)
                out[word] = part.data[word]
        return out

    def encode_slice(self, part: Slice) -> list[bytes]:
        """The ids of each text, little-endian, with END_ID at its end. Each distinct word of a slice is looked up once."""
        data = self._spoken(part)
        start, end, doc = word_bounds(data, part.bounds, NOT_SPACE)
        if self.ending and not ((data[:-1] == 60) & (data[1:] == 124)).any():  # <|
            start, end, doc = _closing_apart(data, start, end, doc)
        words, which = _distinct(data, start, end)
        if len(self.recent) > self.cached:
            self.recent, self.older = {}, self.recent
        recent, older = self.recent, self.older
        found = list(map(recent.get, words))
        lacking = [k for k, ids in enumerate(found) if ids is None]
        new = {words[k] for k in lacking}
        if older:
            again = [w for w in new if w in older]
            recent.update((w, older[w]) for w in again)
            new.difference_update(again)
        self._learn(new)
        for k in lacking:
            found[k] = recent[words[k]]
        self.passing += [w for w in new if len(w) > CACHED_BYTES]
        for w in self.passing:
            self.recent.pop(w, None)
        self.passing.clear()
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, n = (np.cumsum(size) - size)[which], size[which]
        at = np.cumsum(n)
        total = int(at[-1]) if len(at) else 0
        n_docs = len(part.bounds) - 1
        ends = np.cumsum(np.bincount(doc, n, n_docs).astype(np.int64) + 1)
        ids, own = np.full(total + n_docs, END_ID, "<u4"), np.ones(total + n_docs, bool)
        own[ends - 1] = False
        ids[own] = np.frombuffer(b"".join(found), "<u4")[np.repeat(first - at + n, n) + np.arange(total)]
        raw, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts_: list[bytes]) -> list[bytes]:
        """encode_slice() of texts at hand."""
        bounds = np.cumsum([0, *map(len, texts_)])
        return self.encode_slice(Slice(0, len(texts_), np.frombuffer(b"".join(texts_), np.uint8), bounds))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MARK, _PLAIN = (np.isin(np.arange(256), np.frombuffer(x.encode(), np.uint8)) for x in (string.punctuation, string.ascii_letters + string.digits))


def _closing_apart(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with one mark of punctuation behind a letter or digit as two, as the vocabulary's rules take them."""
    split = np.flatnonzero(_MARK[data[end - 1]] & _PLAIN[data[end - 2]] & (end - start > 1))
    n = np.ones(len(start), np.int64)
    n[split] = 2
    at, mark = (np.cumsum(n) - n)[split], end[split] - 1
    start, end, doc = np.repeat(start, n), np.repeat(end, n), np.repeat(doc, n)
    end[at], start[at + 1] = mark, mark
    return start, end, doc


def _distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The words from start to end (some maybe twice), and for each occurrence its place among them.

    Words of up to 16 bytes are compared as two numbers and a length, ordered by a hash of these; others as bytes."""
    size, text = end - start, data.tobytes()
    padded = np.zeros(len(data) + 24, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 16,), "<u8", padded, strides=(1,))
    one, two = eight[start] & _MASKS[np.minimum(size, 8)], eight[start + 8] & _MASKS[np.clip(size - 8, 0, 8)]
    key = mix(mix(one) + two + (size.astype(np.uint64) << np.uint64(56)))
    key[size > 16] = 0
    order = np.argsort(key)
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    model = order[new]
    of = model[which]
    apart = np.flatnonzero((size > 16) | (one != one[of]) | (two != two[of]) | (size != size[of]))
    words = [text[a:b] for a, b in zip(start[model].tolist(), end[model].tolist())]
    more: dict[bytes, int] = {}
    which[apart] = [more.setdefault(text[a:b], len(words) + len(more)) for a, b in zip(start[apart].tolist(), end[apart].tolist())]
    return [*words, *more], which


@lru_cache(maxsize=1)
def encoder_of(tokenizer_json: str) -> WordEncoder:
    """A worker's encoder; its cache of words outlives a task."""
    return WordEncoder(tokenizer_json)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    return Path(public_tokenizers.path(name)).read_text()


def write(docs: DataFrame, tokenizer_json: str, segment_ids: int = SEGMENT_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored segments: task, at (ids before it in the task), doc_ids, lengths, n_ids, segment."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, at = encoder_of(sent.value), TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        names: list = []

        def segment() -> pa.RecordBatch:
            nonlocal at, ids, names
            whole = np.frombuffer(b"".join(ids), "<u4")
            row = {"task": task, "at": at, "doc_ids": names, "lengths": [len(x) // 4 for x in ids], "n_ids": len(whole), "segment": pack(whole)}
            at, ids, names = at + len(whole), [], []
            return pa.RecordBatch.from_pylist([row], _STORED)

        for batch in batches:
            names_in, size = batch.column(0).to_pylist(), 0
            for part in text_slices(batch.column(1), SLICE_BYTES):
                for name, own in zip(names_in[part.lo : part.hi], encoder.encode_slice(part), strict=True):
                    ids.append(own)
                    names.append(name)
                    size += len(own) // 4
                    if size >= segment_ids:
                        yield segment()
                        size = 0
            if ids:
                yield segment()

    rows = texts(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return written(in_batches(dealt, run, "task int, at long, doc_ids array<long>, lengths array<int>, n_ids long, segment binary"), "token-segments", "uncompressed")


_STORED = pa.schema([("task", pa.int32()), ("at", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("segment", pa.binary())])


def read(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the stored segments."""
    totals = {r["task"]: r["n"] for r in stored.groupBy("task").agg(F.sum("n_ids").alias("n")).collect()}  # a row for each task
    before, base = 0, {}
    for task in sorted(totals):
        base[task] = before
        before += totals[task]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = unpack(batch.column("segment")[k].as_py()).astype("<u4")
                lengths = batch.column("lengths")[k].values.to_numpy()
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = base[batch.column("task")[k].as_py()] + batch.column("at")[k].as_py() + ends - lengths
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[k].values, pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents"), tokenizer_file()))


QUERIES = {"op2_tokens": op2_tokens}
SQL: dict[str, str] = {}
