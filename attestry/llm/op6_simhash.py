"""SimHash near-duplicates: BK-trees over shards of fingerprints, linked into components.

A text's fingerprint is the bitwise majority of the XXH64 values of its word shingles. Two fingerprints within RADIUS
of 4 bits agree in two of six blocks of bits at least, whatever bits differ, so each pair of blocks and its value is a
shard, and every linked pair meets in one. A shard's BK-tree (children keyed by their Hamming distance to the parent)
answers which of its members lie within the radius and follows only the edges that can hold them. The trees are not
broadcast to all tasks, since all of them together grow with the corpus: a shuffle brings each to the members that
can match it. Shards of more than CHUNK fingerprints are split, and every two parts of one meet in a task of their own;
the 15 x 2^22 shards have 4096 members each at some 10^10 distinct fingerprints, beyond which that grows with the square.

Texts that share four fifths of their shingles differ in more bits than blocks can answer for. For these (similarity
set, as in the pipeline) shards are shingle hashes, and the search is exact: in any one order of all hashes, two sets of
that Jaccard index share a hash among the first n - ceil(similarity n) + 1 of each. The order puts last what stands in
many texts, as told by counts of 2^16 ranges of hashes, so that common passages make no shards where rarer hashes do.
Members whose sizes, and whose numbers of hashes in 256 ranges, leave the index possible are compared, and the Jaccard
index of their sets of 64-bit shingle hashes decides. Fingerprints decide nothing here, since shingles that repeat move
them. Of shards with the same members one is kept, and its members carry their texts, from which shingles are made once more.

Only distinct fingerprints are sharded (distinct word sequences with similarity), a shard gives a spanning forest and not its pairs, and the forest's components
are found by alternating large-star and small-star joins, each round written to the shared folder. A node with more than
one in MOST_HOT of the edges is one of MOST_HOT at most; what these join with is broadcast, so that the star of a giant
group isn't one task.

Edge cases: null, empty and blank texts have the fingerprint 0 and link like any other; fewer words than a shingle make
one shingle of them all; repeated rows are in one component and each is returned; a null doc_id links nothing and its
component is null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.llm.common import in_batches, joined_by, mix, table, text_slices, texts, written

WORDS, RADIUS, SEED, CHUNK = 4, 4, 42, 4096
#: Nodes of a graph that are held to be hot are as many at most, and have LEAST_HOT edges at least.
MOST_HOT, LEAST_HOT = 1000, 256
#: First bit and width of six blocks of the 64 bits.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Ranges of hashes whose numbers in a set bound what two sets share, and bits of those that tell which hashes are common.
SKETCH, HEAT_BITS = 256, 16
#: What a number of hashes in a range is cut at; larger sets are compared whatever their sketches.
FULL = 65535
#: The radius that goes with a similarity: all 64 bits, so that fingerprints exclude nothing.
WIDE_RADIUS = 64


def shingle_hashes(found: list[bytes], words: int) -> np.ndarray:
    joined = b" ".join(found)
    ends = np.cumsum([len(x) + 1 for x in found]) - 1
    k = min(words, len(found))
    starts = [0, *(ends[: len(found) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype=">u8")


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes, as a signed 64-bit number."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 255):  # so that a byte holds each count
        total += np.unpackbits(hashes[i : i + 255].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Majority bits of the shingles' hashes; 0 without words."""
    found = text.lower().split()
    return majority(shingle_hashes(found, words)) if found else 0


def distinct_hashes(found: list[bytes], words: int) -> np.ndarray:
    """The sorted distinct hashes of shingles, none without words."""
    return np.unique(mix(shingle_hashes(found, words).astype(np.uint64))) if found else np.zeros(0, np.uint64)


def heat(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The place of each range of hashes in the order of how often texts hold one of its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << HEAT_BITS, np.int64)
        for batch in batches:
            for part in text_slices(batch.column(1)):
                data, bounds = part.data.tobytes(), part.bounds.tolist()
                sets = [distinct_hashes(data[a:b].lower().split(), words) for a, b in zip(bounds, bounds[1:])]
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - HEAT_BITS)).astype(np.int64), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "n"])

    told = in_batches(texts(docs, id_col, text_col), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # 2^16 rows at most
    counts = np.zeros(1 << HEAT_BITS, np.int64)
    counts[[r["at"] for r in told]] = [r["n"] for r in told]
    place = np.empty(len(counts), np.int64)
    place[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    return place


def prefix(hashes: np.ndarray, place: np.ndarray, similarity: float) -> np.ndarray:
    """The first of a set's sorted hashes in the order of places, of which sets as similar share one at least."""
    n = len(hashes)
    first = n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0
    return hashes[np.argsort(place[(hashes >> np.uint64(64 - HEAT_BITS)).astype(np.int64)], kind="stable")[:first]]


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """doc_id, h (the text's own hash) and fp of every row; with a similarity also words_key and prefix."""
    place = None if similarity is None else heat(docs, words, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys, firsts = [], [], []
            for part in text_slices(batch.column(1)):
                data, bounds = part.data.tobytes(), part.bounds.tolist()
                for a, b in zip(bounds, bounds[1:]):
                    found = data[a:b].lower().split()
                    hashes = shingle_hashes(found, words) if found else np.zeros(0, ">u8")
                    fps.append(majority(hashes) if found else 0)
                    if place is not None:
                        own = distinct_hashes(found, words)
                        keys.append(xxhash.xxh128_digest(b" ".join(found)))
                        firsts.append(prefix(own, place, similarity).view(np.int64))
            more = {}
            if place is not None:
                flat, ends = pa.array(np.concatenate([np.zeros(0, np.int64), *firsts])), np.cumsum([0, *map(len, firsts)])
                more = {"words_key": pa.array(keys, pa.binary()), "prefix": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)}
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.int64()), *more.values()], names=["doc_id", "h", "fp", *more])

    schema = "doc_id long, h long, fp long" + (", words_key binary, prefix array<long>" if place is not None else "")
    return in_batches(texts(docs, id_col, text_col).withColumn("h", F.xxhash64("text")), run, schema)


class BKTree:
    """Fingerprints by Hamming distance: all that lie below the child at key k are k bits from the node."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int, item: int) -> None:
        if self.root is None:
            self.root = [value, item, {}]
            return
        node = self.root
        while (k := (node[0] ^ value).bit_count()) in node[2]:
            node = node[2][k]
        node[2][k] = [value, item, {}]

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            k = (node[0] ^ value).bit_count()
            if k <= radius:
                found.append(node[1])
            if children := node[2]:
                todo += [children[x] for x in range(k - radius, k + radius + 1) if x in children] if len(children) > 2 * radius else [c for x, c in children.items() if -radius <= x - k <= radius]
        return found


def forest(values: list[int], reps: list[int], first: list[bool], radius: int) -> list[tuple[int, int]]:
    """(rep, smallest rep) of what a shard links. first: the members that make the tree; if all do, it grows as it is asked."""
    parent = list(range(len(values)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    tree, whole = BKTree(), all(first)
    if not whole:
        for i, value in enumerate(values):
            if first[i]:
                tree.add(value, i)
    for i, value in enumerate(values):
        if whole or not first[i]:
            near, own = tree.within(value, radius), top(i)
            for j in [j for j in near if top(j) != own]:
                a, b = top(i), top(j)
                if a != b:
                    parent[max(a, b, key=lambda x: reps[x])] = min(a, b, key=lambda x: reps[x])
            if whole:
                tree.add(value, i)
    return [(reps[i], reps[t]) for i in range(len(values)) if (t := top(i)) != i]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets as sorted arrays; two empty ones are the same."""
    both = np.intersect1d(a, b, assume_unique=True).size
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def alike(sets: list[np.ndarray], reps: np.ndarray, first: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """(rep, smallest rep) of what a shard links by similarity. sets: sorted distinct hashes; first: the members that the others are compared with; if all are, all are."""
    label, whole = np.arange(len(reps)), bool(first.all())
    sketches = np.array([np.bincount((x >> np.uint64(56)).astype(np.int64), minlength=SKETCH).clip(max=FULL) for x in sets], np.uint16)
    others, size = np.flatnonzero(first), np.array([len(x) for x in sets])
    least, slack = similarity / (1 + similarity), 1e-6
    for i in range(len(reps)) if whole else np.flatnonzero(~first):
        near = others[:i] if whole else others
        near = near[(label[near] != label[i]) & (size[near] >= similarity * size[i] - slack) & (size[i] >= similarity * size[near] - slack)]
        both = np.minimum(sketches[near], sketches[i]).sum(axis=1, dtype=np.int64)
        able = (both >= least * (size[near] + size[i]) - slack) | (size[i] >= FULL)
        near = near[able][np.argsort(-both[able], kind="stable")]
        for j in near:
            if label[i] != label[j] and jaccard(sets[i], sets[j]) >= similarity:
                a, b = sorted((label[i], label[j]), key=lambda x: reps[x])
                label[label == b] = a
    return [(int(reps[i]), int(reps[t])) for i, t in enumerate(label) if t != i]


def with_texts(met: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """met with the text of its doc_id and h."""
    each = texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("h"), "text").where("doc_id IS NOT NULL")
    return met.join(each.groupBy("doc_id", "h").agg(F.first("text").alias("text")), ["doc_id", "h"])


def links(classes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, similarity: float | None = None, words: int = WORDS, texted: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(u, v) with v < u that join the linked classes: fp, rep, and first and prefix if a similarity is set; then texted gives members their texts, of whose words shingles are made."""
    count = F.count("*").alias("n")
    if similarity is None:
        assert radius <= 4, "two of six blocks agree only within 4 bits"
        field = [f"(shiftrightunsigned(fp, {at}) & {(1 << width) - 1}L)" for at, width in BLOCKS]
        keys = [f"{n}L << 22 | {field[a]} << 11 | {field[b]}" for n, (a, b) in enumerate(combinations(range(6), 2))]
        keyed = classes.select("fp", "rep", F.explode(F.expr(f"array({', '.join(keys)})")).alias("shard"))
        sizes = keyed.groupBy("shard").agg(count).where("n > 1")
    else:
        keyed = classes.select("rep", F.size("prefix").alias("width"), F.explode("prefix").alias("shard"))
        keyed = keyed.join(keyed.groupBy("shard").agg(count).where("n > 1").select("shard"), "shard")
        # of a shard's members by size, one whose neighbours are too small and too large links none; sizes follow from widths to within a few
        by_width = Window.partitionBy("shard").orderBy("width")
        near = (F.lag("width").over(by_width) >= similarity * (F.col("width") - 1) - 1e-6) | (F.col("width") >= similarity * (F.lead("width").over(by_width) - 1) - 1e-6)
        keyed = written(keyed.withColumn("near", near).where("near").select("rep", "shard"), "shard-members")
        marks = [F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"mark{k}") for k in (0, 1)]
        sizes = keyed.groupBy("shard").agg(count, *marks).groupBy("n", "mark0", "mark1").agg(F.min("shard").alias("shard")).select("shard", "n")
    more = [] if similarity is None else ["text"]
    met = keyed.join(sizes, "shard")
    if similarity is not None:
        met = met.withColumn("fp", F.col("rep")).join(classes.select("rep", "first.doc_id", "first.h"), "rep")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    met = met.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("fp", "rep"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    met = met.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))
    met = (met if similarity is None else texted(met)).select("shard", "a", "b", "own", "fp", "rep", *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None

        def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
            out = [c.to_numpy() for c in batch.columns[:6]]
            return [*out, batch.column(6).to_numpy(False)] if more else out

        def out(rows: list[np.ndarray], ended: bool) -> tuple[list[np.ndarray] | None, list[tuple[int, int]]]:
            shard, a, b, own, fp, rep = rows[:6]
            cut = np.flatnonzero((shard[1:] != shard[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            cut = np.concatenate([[0], cut, [len(shard)]]) if len(shard) else np.zeros(1, np.int64)
            last = len(cut) - 1 if ended else len(cut) - 2
            edges: list[tuple[int, int]] = []
            for i in np.flatnonzero(np.diff(cut[: last + 1]) > 1):
                x = slice(cut[i], cut[i + 1])
                if more:
                    edges += alike([distinct_hashes(t.encode().lower().split(), words) for t in rows[6][x]], rep[x], own[x] == a[x], similarity)
                else:
                    edges += forest(fp[x].view(np.uint64).tolist(), rep[x].tolist(), (own[x] == a[x]).tolist(), radius)
            return ([r[cut[last] :] for r in rows] if not ended else None), edges

        for batch in batches:
            rows = columns(batch)
            kept, edges = out(rows if kept is None else [np.concatenate(x) for x in zip(kept, rows)], False) if batch.num_rows else (kept, [])
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["u", "v"])
        if kept is not None:
            _, edges = out(kept, True)
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["u", "v"])

    met = met.repartition("shard", "a", "b").sortWithinPartitions("shard", "a", "b", "own", "fp")
    return in_batches(met, run, "u long, v long")


def _with_least(rows: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """rows (u, v) with m, what least (u, m, n) has for u; n is how many rows u has."""
    hot = least.where(F.col("n") > max(LEAST_HOT, 2 * n_edges // MOST_HOT)).select("u", "m")  # MOST_HOT rows at most
    told = rows.join(F.broadcast(hot), "u", "left")
    return told.where("m IS NOT NULL").unionByName(told.where("m IS NULL").drop("m").join(least.select("u", "m"), "u"))


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of the nodes that edges (u, v) touch."""
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state, n = None, e.count()
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both.where("v > u"), least, n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least, n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = written(small.distinct(), "links")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state, n = now, now[0]


def grouped(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """doc_id, h, fp and component_id of every row."""
    name = "fp" if similarity is None else "words_key"
    fps = written(fingerprints(docs, words, id_col, text_col, similarity), "fingerprints")
    own = [] if similarity is None else [F.min(F.struct("doc_id", "h")).alias("first"), *(F.first(c).alias(c) for c in ("fp", "prefix"))]
    classes = written(fps.where("doc_id IS NOT NULL").groupBy(name).agg(F.min("doc_id").alias("rep"), *own), "classes")
    found = components(links(classes, radius, chunk, similarity, words, lambda met: with_texts(met, docs, id_col, text_col)))
    named = classes.select(name, "rep").join(found, F.col("rep") == F.col("node"), "left").select(name, F.coalesce("component", "rep").alias("component_id"))
    told = joined_by(fps.where("doc_id IS NOT NULL"), written(named, "components"), name)  # copies and empty texts share one
    return told.unionByName(fps.where("doc_id IS NULL"), allowMissingColumns=True).select("doc_id", "h", "fp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay: of each component one with its smallest doc_id; rows without a doc_id stay."""
    found = grouped(docs, id_col=id_col, text_col=text_col, **options).where("doc_id IS NOT NULL")
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    keep = written(first.select(F.col("first.doc_id").alias("kept_id"), F.col("first.h").alias("kept_h")), "kept")
    named = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("own_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("own_h"))
    out = named.join(keep, (F.col("own_id") == F.col("kept_id")) & (F.col("own_h") == F.col("kept_h")), "left_semi")
    if docs.groupBy(id_col).count().where(f"count > 1 AND `{id_col}` IS NOT NULL").limit(1).count():  # equal rows: one of them
        out = out.dropDuplicates(["own_id", "own_h"])
    return out.unionByName(named.where("own_id IS NULL")).select("row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouped(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash": op6_simhash}
SQL: dict[str, str] = {}
