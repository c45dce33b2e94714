"""SentencePiece encoding and decoding by a streaming Viterbi search.

The best path over a vocabulary's pieces is found left to right. Only positions within the longest piece of the front
can still change what follows; whenever the backpointers of all of them lead through one boundary, the ids before it
are committed and forgotten, so a text of any length is encoded in a window and not in a table of its length.

Stream is that search as it is, a character at a time. Search runs many such windows side by side, in numpy: words are
windows of their own, and longer runs of text are cut into windows of STEP characters that overlap by LEAD. A window
that starts inside a run guesses that a boundary is there; where its scores differ from those of the window before by
one constant over as many positions as the longest piece has characters, both have the same paths from there on, and
the two are joined; a run in which that doesn't happen is left to Stream. After CHUNK characters a run is committed up to
the boundary through which all surviving paths lead, and goes on from there.

The vocabulary file ranks its pieces (it was made by merging), so a piece of rank r scores -log(r + 2), a
frequency law, in millionths, so that sums are exact in any order.
Spaces are the piece mark; no piece holds a mark after another character (checked), so a space is such a boundary always
and words are encoded once for as long as a worker's cache holds them: CACHED_WORDS of at most CACHED_CHARS characters.
Characters without a piece, and a mark that was in the text itself, become byte pieces, so decoding gives back every text
exactly.

Edge cases: null and empty texts have no ids; very long texts and words are searched in windows; equal scores prefer the
piece that starts first; repeated rows are encoded each; an empty table gives no rows; other columns are not read by
encoded().
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import in_batches, mix, powers, table, text_slices, texts

MARK, CACHED_WORDS, CACHED_CHARS = "▁", 100_000, 24


class Pieces:
    """A SentencePiece vocabulary with scores by rank and its byte pieces."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids: dict[str, int] = {}
        self.score: dict[int, int] = {}
        self.byte_id = [0] * 256
        self.bytes_of = [b""] * sp.get_piece_size()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                self.score[i] = -round(1e6 * math.log(max(0.0, -sp.get_score(i)) + 2))
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        self.byte_score = min(self.score.values(), default=0) - 10_000_000
        self.longest = max(map(len, self.ids), default=1)
        self.words_apart = not any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids)

    def symbols(self, text: str) -> str:
        """Spaces as marks; a mark of the text's own as a character that no piece has."""
        return text.replace(MARK, "\0").replace(" ", MARK)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode()


class Stream:
    """Viterbi over characters that arrive in order; ids leave as soon as every path that is left agrees on them."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self._begin()

    def _begin(self) -> None:
        self.done: list[int] = []
        self.widest, self.due = 0, 2 * self.pieces.longest
        self.plain = self.text = ""  # characters from the last commit on, as they were and as symbols
        self.best: list[int] = [0]  # score by position after that commit
        self.back: list[tuple[int, tuple[int, ...]]] = [(-1, ())]  # previous position and the ids from there

    def push(self, plain: str) -> None:
        p, at = self.pieces, len(self.best)
        self.plain += plain
        self.text += p.symbols(plain)
        text, best, find, score = self.text, self.best, p.ids.get, p.score
        for end in range(at, len(text) + 1):
            top, back = None, (-1, ())
            for start in range(max(0, end - p.longest), end):
                i = find(text[start:end])
                if i is not None and (top is None or best[start] + score[i] > top):
                    top, back = best[start] + score[i], (start, (i,))
            if top is None or end - back[0] > 1:
                raw = self.plain[end - 1].encode()
                value = best[end - 1] + p.byte_score * len(raw)
                if top is None or value > top:
                    top, back = value, (end - 1, tuple(p.byte_id[b] for b in raw))
            best.append(top)
            self.back.append(back)
        self.widest = max(self.widest, len(best) - 1)
        if len(best) > self.due:
            self._commit(len(best) - p.longest)
            self.due = 2 * max(p.longest, len(self.best))  # paths that don't meet yet aren't walked at each step

    def _commit(self, first_live: int) -> None:
        """Commits up to the boundary through which all positions from first_live on lead."""
        live = set(range(first_live, len(self.best)))
        while len(live) > 1:
            live.add(self.back[top := max(live)][0])
            live.discard(top)
        at = live.pop()
        if at > 0:
            self._take(at)
            self.plain, self.text = self.plain[at:], self.text[at:]
            self.best = self.best[at:]
            self.back = [(-1, ()), *((start - at, ids) for start, ids in self.back[at + 1 :])]

    def _take(self, at: int) -> None:
        parts = []
        while at > 0:
            at, ids = self.back[at]
            parts.append(ids)
        for ids in reversed(parts):
            self.done += ids

    def finish(self) -> list[int]:
        self._take(len(self.best) - 1)
        out = self.done
        self._begin()
        return out


def stream_encode(pieces: Pieces, text: str, step: int = 64) -> list[int]:
    stream = Stream(pieces)
    for i in range(0, len(text), step):
        stream.push(text[i : i + step])
    return stream.finish()


class Search:
    """The same search in many windows at once, a character of each at a time.

    Scores are kept times 32 with a piece's length added, so that one maximum finds the best and, of equal ones, the
    piece that starts first.
    """

    STEP, LEAD, CHUNK = 240, 64, 1 << 17  # many a period divides STEP, so that windows meet in periodic text too
    SLOT_BITS, PREFIX_BITS = 18, 22
    _SPREAD = np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, pieces: Pieces) -> None:
        if pieces.longest > 31:
            raise ValueError("pieces of more than 31 characters")
        self.pieces, self.longest = pieces, pieces.longest
        self._powers, self._inverse = powers(4 * self.CHUNK)
        names = list(pieces.ids)
        flat = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(x) for x in names], np.int64)
        start = np.cumsum(lengths) - lengths
        sums = self._sums(flat)
        self.prefix = np.zeros(1 << self.PREFIX_BITS, bool)
        for k in range(1, self.longest + 1):
            own = start[lengths >= k]
            self.prefix[self._spread(self._runs(sums, own, k))] = True
        keys, left = self._runs(sums, start, lengths), np.arange(len(names))
        self.tables = []  # key and id by slot; what collides goes to the next table
        while len(left):
            _, first = np.unique(self._slots(keys[left], len(self.tables)), return_index=True)
            at = self._slots(keys[left[first]], len(self.tables))
            key, ident = np.zeros(1 << self.SLOT_BITS, np.uint64), np.full(1 << self.SLOT_BITS, -1, np.int32)
            key[at] = keys[left[first]]
            ident[at] = [pieces.ids[names[i]] for i in left[first]]
            self.tables.append((key, ident))
            left = np.delete(left, first)
        self.score = np.zeros(len(pieces.bytes_of), np.int64)
        self.score[list(pieces.score)] = list(pieces.score.values())
        self.byte_id = np.array(pieces.byte_id, np.int32)

    def _sums(self, flat: np.ndarray) -> np.ndarray:
        out = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * self._powers[: len(flat)], out=out[1:])
        return out

    def _runs(self, sums: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hashes of the runs of size characters from each start."""
        return (sums[start + size] - sums[start]) * self._inverse[start]

    def _spread(self, h: np.ndarray) -> np.ndarray:
        return (h * self._SPREAD >> np.uint64(64 - self.PREFIX_BITS)).astype(np.int64)

    def _slots(self, keys: np.ndarray, turn: int) -> np.ndarray:
        return (mix(keys + np.uint64(turn)) >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)

    def _ends(self, plain: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of the piece of each length (longest first) that ends with each character. room: characters left in its run."""
        n, most = len(plain), self.longest
        sums = self._sums(np.where(plain == 32, ord(MARK), np.where(plain == ord(MARK), 0, plain)))
        score, ident = np.full((most, n), -(1 << 58), np.int64), np.full((most, n), -1, np.int32)
        cost = 1 + (plain >= 0x80).astype(np.int64) + (plain >= 0x800) + (plain >= 0x10000)
        score[-1] = self.pieces.byte_score * cost * 32 + 1
        alive = np.arange(n)
        for k in range(1, most + 1):
            alive = alive[room[alive] >= k]
            h = self._runs(sums, alive, k)
            known = self.prefix[self._spread(h)]
            alive, h = alive[known], h[known]
            found = np.full(len(h), -1, np.int32)
            left = np.arange(len(h))
            for turn, (key, name) in enumerate(self.tables):
                at = self._slots(h[left], turn)
                hit = key[at] == h[left]
                found[left[hit]] = name[at[hit]]
                left = left[~hit] if turn + 1 < len(self.tables) else left
            hit = found >= 0
            at = alive[hit] + k - 1
            score[most - k, at], ident[most - k, at] = self.score[found[hit]] * 32 + k, found[hit]
        return score, ident

    def _windows(self, score: np.ndarray, base: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best scores and backpointers (lengths) by position of windows that start at base, a column for each."""
        most, end = self.longest, score.shape[1] - 1
        best, back = np.full((most + width, len(base)), -(1 << 60), np.int64), np.zeros((width + 1, len(base)), np.uint8)
        best[most - 1] = 0
        for t in range(1, width + 1):
            top = (best[t - 1 : t - 1 + most] + score[:, np.minimum(base + (t - 1), end)]).max(0)
            size = top & 31
            best[most - 1 + t], back[t] = top - size, size
        return best[most - 1 :], back

    def _joined(self, best: np.ndarray, back: np.ndarray, n: int) -> np.ndarray | None:
        """The backpointers of a run of n characters from those of its windows; None if two of them don't meet."""
        out, most = back[: n + 1, 0] if back.shape[1] == 1 else np.zeros(n + 1, np.uint8), self.longest
        if back.shape[1] == 1:
            return out
        gap = best[self.STEP : self.STEP + self.LEAD + 1, :-1] - best[: self.LEAD + 1, 1:]
        same = np.cumsum(np.vstack([np.zeros((1, gap.shape[1]), np.int64), gap[1:] == gap[:-1]]), axis=0)
        met = same[most - 1 :] - same[: len(same) - most + 1] == most - 1
        if not met.any(0).all():
            return None
        turn = [0, *(met.argmax(0) + most - 1 + self.STEP * np.arange(1, back.shape[1])).tolist(), n]
        for k, (a, b) in enumerate(zip(turn, turn[1:])):
            out[a + 1 : b + 1] = back[a + 1 - k * self.STEP : b + 1 - k * self.STEP, k]
        return out

    def _ids(self, plain: np.ndarray, ident: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of tokens that end before the places ends, and how many each gives: characters without a piece give their bytes."""
        ids = ident[self.longest - sizes, ends - 1]
        raw = ids < 0
        counts = np.ones(len(ids), np.int64)
        if raw.any():
            own = plain[ends[raw] - 1]
            counts[raw] = 1 + (own >= 0x80).astype(np.int64) + (own >= 0x800) + (own >= 0x10000)
            ids, spread = np.repeat(ids, counts), np.repeat(raw, counts)
            ids[spread] = self.byte_id[np.frombuffer(own.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)]
        return ids.astype("<i4"), counts

    @staticmethod
    def _traced(back: np.ndarray, at: int) -> np.ndarray:
        """Ends of the tokens on the path to a position."""
        sizes, ends = back.tolist(), []
        while at:
            ends.append(at)
            at -= sizes[at]
        return np.array(ends[::-1], np.int64)

    def _run(self, plain: np.ndarray, last: bool) -> tuple[np.ndarray, int] | None:
        """Ids of a run as far as it's committed, and that boundary: its end if it is the last part of its text. None: no such boundary."""
        n = len(plain)
        score, ident = self._ends(plain, np.arange(n, 0, -1))
        n_windows = max(1, -(-(n - self.LEAD) // self.STEP))
        base = np.arange(n_windows) * self.STEP
        best, back = self._windows(score, base, min(n, self.STEP + self.LEAD))
        joined = self._joined(best, back, n)
        if joined is None:
            return None
        at = n
        if not last:
            live = set(range(n - self.longest + 1, n + 1))
            while len(live) > 1:
                top = max(live)
                live.discard(top)
                live.add(top - int(joined[top]))
            at = live.pop()
        ends = self._traced(joined, at)
        return self._ids(plain, ident, ends, joined[ends].astype(np.int64))[0], at

    def long(self, text: str) -> bytes:
        """The ids of a run of any length, little-endian."""
        plain, out, at, size = np.frombuffer(text.encode("utf-32-le"), np.uint32), [], 0, self.CHUNK
        while at < len(plain):
            got = self._run(plain[at : at + size], at + size >= len(plain))
            if got is not None and got[1] == 0 and size < 4 * self.CHUNK:
                size *= 2
                continue
            if got is None or got[1] == 0:
                return b"".join([*out, np.array(stream_encode(self.pieces, text[at:]), "<i4").tobytes()])
            out.append(got[0].tobytes())
            at, size = at + got[1], self.CHUNK
        return b"".join(out)

    def encode(self, words: list[str]) -> list[bytes]:
        """The ids of each word, little-endian."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, 64), (64, self.STEP + self.LEAD)):
            own = np.flatnonzero((sizes > low) & (sizes <= high))
            for part in np.array_split(own, max(1, -(-len(own) * high // self.CHUNK))):
                for k, ids in zip(part.tolist(), self._short([words[k] for k in part], sizes[part]) if len(part) else [], strict=True):
                    out[k] = ids
        for k in np.flatnonzero(sizes > self.STEP + self.LEAD).tolist():
            out[k] = self.long(words[k])
        return out

    def _short(self, words: list[str], sizes: np.ndarray) -> list[bytes]:
        """Words of a window each."""
        plain = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        stop = np.cumsum(sizes)
        base = stop - sizes
        score, ident = self._ends(plain, np.repeat(stop, sizes) - np.arange(len(plain)))
        _, back = self._windows(score, base, int(sizes.max()))
        at, every, taken = sizes.copy(), np.arange(len(words)), []
        while (at > 0).any():
            taken.append(np.where(at > 0, at, 0))
            at = at - np.where(at > 0, back[at, every], 0)
        table = np.stack(taken[::-1], axis=1)
        keep = table > 0
        ends, lengths = table[keep], np.take_along_axis(back.T, table, 1)[keep].astype(np.int64)
        tokens = keep.sum(1)
        ids, counts = self._ids(plain, ident, ends + np.repeat(base, tokens), lengths)
        cut = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(tokens)])] * 4
        raw, cut = ids.tobytes(), cut.tolist()
        return [raw[a:b] for a, b in zip(cut, cut[1:])]


class Encoder:
    """Ids of texts, the words' from a cache of bounded size where words stand apart."""

    def __init__(self, model: bytes, cached: int = CACHED_WORDS) -> None:
        self.pieces, self.cached = Pieces(model), cached
        self.search = Search(self.pieces)
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _words(self, text: str) -> list[str]:
        """The text cut before the first of each run of spaces, and around line ends."""
        words: list[str] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                words.append("\n")
            if "  " in line or line[:1] == " " or line[-1:] == " ":
                words += re.findall(" *[^ ]+| +", line)
            elif line:
                first, *rest = line.split(" ")
                words.append(first)
                words += [" " + w for w in rest]
        return words

    def encode_all(self, texts_: list[str]) -> list[np.ndarray]:
        words = [self._words(t) for t in texts_] if self.pieces.words_apart else [[t] if t else [] for t in texts_]
        if len(self.recent) > self.cached:
            self.recent, self.older = {}, self.recent
        new = set().union(*words) - self.recent.keys()
        if self.older:
            again = new & self.older.keys()
            self.recent.update((w, self.older[w]) for w in again)
            new -= again
        fresh = list(new)
        self.recent.update(zip(fresh, self.search.encode(fresh), strict=True))
        find = self.recent.__getitem__
        out = [np.frombuffer(b"".join(map(find, w)), "<i4") for w in words]
        for w in fresh:
            if len(w) > CACHED_CHARS:
                del self.recent[w]
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


@lru_cache(maxsize=1)
def encoder_of(model: bytes) -> Encoder:
    """A worker's encoder; its cache of words outlives a task."""
    return Encoder(model)


def model_file(name: str = "piece_bpe_32k.model") -> bytes:
    return Path(public_tokenizers.path(name)).read_bytes()


def encoded(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every row, and whether they decode to its text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(sent.value)
        for batch in batches:
            for own in text_slices(batch.column(1)):
                part = batch.slice(own.lo, own.hi - own.lo)
                plain = part.column(1).to_pylist()
                ids = encoder.encode_all(plain)
                same = [encoder.pieces.decode(x.tolist()) == t for x, t in zip(ids, plain, strict=True)]
                crc = [zlib.crc32(x.tobytes()) for x in ids]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "ids", "ids_crc32", "round_trip"])

    return in_batches(texts(docs, id_col, text_col), run, "doc_id long, ids array<int>, ids_crc32 long, round_trip boolean")


def decoded(rows: DataFrame, model: bytes, ids_col: str = "ids") -> DataFrame:
    """rows with the text that their ids stand for; null ids give a null text."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = Pieces(sent.value)
        for ids in batches:
            yield ids.map(lambda x: None if x is None else pieces.decode(x.tolist()))

    return rows.withColumn("decoded", text(F.col(ids_col)))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encoded(table(spark, sf_dir, "documents"), model_file())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "ids_crc32", "round_trip")


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
SQL: dict[str, str] = {}
