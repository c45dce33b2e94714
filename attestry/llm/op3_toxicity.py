"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each present or not: its words, their leading bytes (inflected forms share them), pairs of
neighbouring words and pairs with one word between, hashed into 2^20 slots. FTRL-proximal keeps a rate per
coordinate and its L1 term leaves few weights other than zero; only those are broadcast, whatever the corpus size.

The labelled rows are fitted in one task, on whole texts of at most MAX_ROWS of them with MAX_SLOTS features together,
in the order of a hash of doc_id; scoring reads every whole text once and shuffles nothing.

Edge cases: a null or empty text has no features and gets the bias alone; a very long text is worked on alone, and is
scored by its distinct features like any other; rows whose label is null are not learned from; a doc_id that documents
repeat is learned from with each text, within the bounds; equal scores stay equal; repeated rows are scored each; with no labelled rows, or of one class, every score is the observed share
(0.0 without any); other columns of docs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import ALNUM, Slice, Words, in_batches, mix, table, text_slices, texts

SLOT_BITS = 20
#: Leading bytes of a word that make a feature of their own, if the word is longer.
STEMS = (4, 5, 6, 7)
MAX_ROWS, MAX_SLOTS = 12_000, 1 << 26


def features(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and slots of a slice's features, repeats included."""
    w = Words(part, ALNUM)
    docs, keys = [w.doc], [w.hash]
    for k in STEMS:
        long = w.end - w.start > k
        docs.append(w.doc[long])
        keys.append(w.between(w.start[long], w.start[long] + k) + np.uint64(k))
    for gap in (1, 2):
        same = w.doc[gap:] == w.doc[:-gap]
        docs.append(w.doc[gap:][same])
        keys.append((w.hash[:-gap][same] * np.uint64(0x9FB21C651E98DF25) + w.hash[gap:][same]) * np.uint64(2 * gap + 1))
    return np.concatenate(docs), (mix(np.concatenate(keys)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def fit(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.5, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0, epochs: int = 6, seed: int = 7) -> tuple[np.ndarray, float]:
    """FTRL-proximal over documents' distinct slots: the weights and the bias."""
    share = float(labels.mean()) if len(labels) else 0.0
    z, n = np.zeros(1 << SLOT_BITS), np.zeros(1 << SLOT_BITS)
    if share in (0.0, 1.0):
        return z, 30.0 * (2 * share - 1)
    bias, bias_n = float(np.log(share / (1 - share))), 1.0
    order = np.random.default_rng(seed)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i = rows[k]
            zi, ni = z[i], n[i]
            wi = weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(wi.sum() + bias, -30, 30))) - labels[k]
            if abs(g) < 1e-4:
                continue
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * wi
            n[i] = ni + g * g
            bias_n += g * g
            bias -= alpha * g / np.sqrt(bias_n)
    return weights(z, n), bias


def _distinct(pairs: np.ndarray) -> np.ndarray:
    pairs = np.sort(pairs)
    return pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs


def train(labelled: DataFrame, max_rows: int = MAX_ROWS, max_slots: int = MAX_SLOTS) -> tuple[np.ndarray, np.ndarray, float]:
    """The slots and values of the weights other than zero, and the bias.

    labelled: doc_id, text and label (0, 1) of a bounded sample; texts become slots where they are, the fit is one task
    that takes rows in the order of a hash while they keep within max_rows and max_slots.
    """

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column(1)):
                doc, slot = features(part)
                pairs = _distinct(doc << SLOT_BITS | slot)
                cut = np.searchsorted(pairs, np.arange(part.hi - part.lo + 1) << SLOT_BITS)
                found = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array((pairs & ((1 << SLOT_BITS) - 1)).astype(np.int32)))
                own = batch.slice(part.lo, part.hi - part.lo)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), found], names=["doc_id", "label", "slots"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, labels, size = [], [], 0
        for batch in batches:
            for slots_, label in zip(batch["slots"], batch["label"], strict=True):
                if len(found) < max_rows and size + len(slots_) <= max_slots:
                    found.append(slots_)
                    labels.append(label)
                    size += len(slots_)
        w, bias = fit(found, np.array(labels, float))
        at = np.flatnonzero(w)
        yield pd.DataFrame({"slot": np.append(at, -1).astype(np.int64), "weight": np.append(w[at], bias)})

    rows = labelled.select("doc_id", "text", F.col("label").cast("double").alias("label")).where("label IS NOT NULL")
    made = in_batches(rows, slots, "doc_id long, label double, slots array<int>")
    order = made.select("*", F.xxhash64(F.col("doc_id").cast("string")).alias("place"), F.xxhash64("slots", "label").alias("tie"))
    model = order.repartition(1).sortWithinPartitions("place", "doc_id", "tie").select("label", "slots").mapInPandas(run, "slot long, weight double").toPandas()
    bias = model.loc[model["slot"] < 0, "weight"]
    model = model[model["slot"] >= 0]
    return model["slot"].to_numpy(), model["weight"].to_numpy(), float(bias.iloc[0]) if len(bias) else -30.0


def dense(model: tuple[np.ndarray, np.ndarray, float]) -> tuple[np.ndarray, float]:
    weight = np.zeros(1 << SLOT_BITS, np.float32)
    weight[model[0]] = model[1]
    return weight, model[2]


def scores(column: pa.Array, weight: np.ndarray, bias: float) -> np.ndarray:
    """The scores of a column of texts."""
    total = np.full(len(column), bias)
    for part in text_slices(column):
        doc, slot = features(part)
        hit = weight[slot] != 0
        pairs = _distinct(doc[hit] << SLOT_BITS | slot[hit])
        total[part.lo : part.hi] += np.bincount(pairs >> SLOT_BITS, weight[pairs & ((1 << SLOT_BITS) - 1)], part.hi - part.lo)
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _sent(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]):
    """The weights other than zero, at most 2^SLOT_BITS floats whatever the data, as a broadcast."""
    return docs.sparkSession.sparkContext.broadcast((model[0].astype(np.int32), model[1].astype(np.float32), model[2]))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    sent = _sent(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = dense(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), weight, bias))], names=["doc_id", "score"])

    return in_batches(texts(docs, id_col, text_col), run, "doc_id long, score double")


def kept(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that score below the threshold."""
    sent, at = _sent(docs, model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = dense(sent.value)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at), weight, bias) < threshold))

    return in_batches(docs, run, docs.schema)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts with their label, of the rows that may be learned from. labels has one row for each labelled document."""
    known = labels.where(~held_out() & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("label"))
    known = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(MAX_ROWS)
    return texts(docs).join(F.broadcast(known), "doc_id")  # bounded by MAX_ROWS


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, train(labelled_rows(docs, labels)))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_toxicity": op3_toxicity}
SQL: dict[str, str] = {}
