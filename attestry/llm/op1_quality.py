"""Quality: positive-unlabelled learning with the non-negative risk.

A linear model over shape features of a text (case, symbols, repetition, lengths) minimises
pi R+(1) + max(0, Ru(0) - pi R+(0)): trusted positives stand for quality, every document of the corpus for the
unlabelled mixture, and pi, the share of quality in it, is estimated from both as the smallest ratio of their score
tails. Labels of junk are never used.

Texts are read once, into a table of features in the shared folder. Each round deals that table's rows over groups of
about GROUP_ROWS by a hash of the rows themselves, fits the model on every whole group and averages by rows. So all
documents take part, no task holds more than a group, and the scores don't depend on how files or partitions are cut. The
trusted positives are at most MAX_POSITIVES rows by a hash of doc_id.

Edge cases: null and empty texts have the features of no words and are scored; rows with a null label are not
trusted; without trusted positives every score is 0.5; a very long text is one row of features, worked on alone; equal
scores stay equal (ties break nothing); repeated rows count each; other columns of docs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import NOT_SPACE, Slice, Words, byte_set, in_batches, table, text_slices, texts, written

NAMES = ("words", "word_bytes", "upper", "lower", "digits", "symbols", "bang", "bar", "odd_end", "adjacent", "distinct", "distinct_pairs", "lines", "long_words")
MAX_POSITIVES = 20_000
#: STEPS is the least for a group; a larger one takes as many as show it each row once.
ROUNDS, STEPS, BATCH, GROUP_ROWS = 3, 80, 8192, 65_536

_UPPER, _LOWER, _DIGIT = byte_set((65, 90)), byte_set((97, 122), (128, 255)), byte_set((48, 57))
_SYMBOL = byte_set((33, 47), (58, 64), (91, 96), (123, 126))
_PLAIN_END = _UPPER | _LOWER | _DIGIT | byte_set((44, 44), (46, 46), (63, 63), (58, 59))


def features(part: Slice) -> np.ndarray:
    """A row of NAMES for each document of a slice."""
    w, data, n = Words(part, NOT_SPACE), part.data, part.hi - part.lo
    doc_of = np.repeat(np.arange(n), np.diff(part.bounds))

    def per_doc(table: np.ndarray) -> np.ndarray:
        return np.bincount(doc_of, table[data], n)

    def distinct(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
        keys = np.sort(doc.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20))
        first = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
        return np.bincount((keys[first] >> np.uint64(44)).astype(np.int64), minlength=n)

    words, chars = np.maximum(w.count, 1), np.maximum(per_doc(NOT_SPACE), 1)
    same = w.doc[1:] == w.doc[:-1]
    pairs = np.maximum(np.bincount(w.doc[1:][same], minlength=n), 1)
    lengths = w.end - w.start
    return np.column_stack([
        np.log1p(w.count),
        chars / words,
        *(per_doc(t) / chars for t in (_UPPER, _LOWER, _DIGIT, _SYMBOL, byte_set((33, 33)), byte_set((124, 124)))),
        np.bincount(w.doc, ~_PLAIN_END[data[w.end - 1]], n) / words,
        np.bincount(w.doc[1:][same], (w.hash[1:] == w.hash[:-1])[same], n) / pairs,
        np.log(np.maximum(distinct(w.doc, w.hash), 1) / words),
        np.log(np.maximum(distinct(w.doc[1:][same], (w.hash[:-1] * np.uint64(3) + w.hash[1:])[same]), 1) / pairs),
        per_doc(byte_set((10, 10))) / words,
        np.bincount(w.doc, lengths > 24, n) / words,
    ])


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column(1)):
                x = features(part).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.lo, part.hi - part.lo), *(pa.array(c) for c in x.T)], names=["doc_id", *NAMES])

    return in_batches(texts(docs, id_col, text_col), run, "doc_id long, " + ", ".join(f"{c} float" for c in NAMES))


def nnpu(start: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = 0.1, decay: float = 1e-3) -> np.ndarray:
    """Adam on the non-negative risk under the logistic loss; the last weight is the bias. All rows of unlabelled are seen."""
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    positive, unlabelled = (np.column_stack([x, np.ones(len(x))]) for x in (positive, unlabelled))
    turns = -(-len(unlabelled) // BATCH)
    for k in range(max(steps, turns)):
        u = unlabelled[k % turns * BATCH :][:BATCH]
        zp, zu = np.clip(positive @ w, -30, 30), np.clip(u @ w, -30, 30)
        gain = (1 / (1 + np.exp(-zp))) @ positive / len(positive)  # gradient of the positives' loss as negatives
        negative = np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()
        rest = (1 / (1 + np.exp(-zu))) @ u / len(u) - prior * gain
        g = -rest if negative < 0 else prior * (gain - positive.mean(0)) + rest
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9 ** (k + 1))) / (np.sqrt(v / (1 - 0.99 ** (k + 1))) + 1e-8)
    return w


def _averaged(grouped: DataFrame, start: np.ndarray, positive: np.ndarray, scale: tuple[np.ndarray, np.ndarray], prior: float) -> np.ndarray:
    """One round: the model fitted on each group, averaged by its rows."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values(["place", "doc_id", *NAMES])[list(NAMES)].to_numpy(float)
        w = nnpu(start, positive, (own - scale[0]) / scale[1], prior)
        return pd.DataFrame({"group": [int(group["group"].iloc[0])], "n": [len(own)], "w": [w.tolist()]})

    got = grouped.groupBy("group").applyInPandas(run, "group long, n long, w array<double>").toPandas().sort_values("group")  # a row for each group
    return np.average(np.stack(got["w"]), axis=0, weights=got["n"]) if len(got) else start


def _margin(w: np.ndarray, scale: tuple[np.ndarray, np.ndarray]) -> F.Column:
    slope = w[:-1] / scale[1]
    out = F.lit(float(w[-1] - slope @ scale[0]))
    for c, a in zip(NAMES, slope, strict=True):
        out = out + F.col(c).cast("double") * F.lit(float(a))
    return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), out))


def estimated_prior(feats: DataFrame, positive: np.ndarray, w: np.ndarray, scale: tuple[np.ndarray, np.ndarray], least_tail: float = 0.3) -> float:
    """The smallest ratio of the corpus's score tail to the positives', over tails with least_tail of the positives."""
    edges = np.linspace(-30, 30, 601)
    rows = feats.groupBy(F.floor((_margin(w, scale) + 30) * 10).cast("int").alias("bin")).count().collect()  # 601 at most
    corpus = np.zeros(len(edges))
    for r in rows:
        corpus[r["bin"]] += r["count"]
    own = np.bincount(np.floor((np.clip(positive @ w[:-1] + w[-1], -30, 30) + 30) * 10).astype(int), minlength=len(edges))
    tail_u, tail_p = (x[::-1].cumsum()[::-1] / max(x.sum(), 1) for x in (corpus, own))
    ratio = tail_u[tail_p >= least_tail] / tail_p[tail_p >= least_tail]
    return float(np.clip(ratio.min(initial=1.0), 0.01, 0.99))


def score(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row of docs. trusted: doc_id of the rows that are known to be positive."""
    feats = written(featured(docs, id_col, text_col), "quality-features")
    sums = feats.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in NAMES), *(F.stddev_pop(c).alias(f"s_{c}") for c in NAMES)).first()
    scale = tuple(np.array([float(sums[f"{k}_{c}"] or 0) for c in NAMES]) for k in "ms")
    scale = (scale[0], np.maximum(scale[1], 1e-3))
    sample = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    sample = sample.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(MAX_POSITIVES)
    known = feats.join(F.broadcast(sample), "doc_id", "left_semi").orderBy("doc_id", *NAMES).limit(MAX_POSITIVES)  # both bounded
    positive = known.select(*NAMES).toPandas().to_numpy(float)
    if not len(positive):
        return feats.select("doc_id", F.lit(0.5).alias("score"))
    positive = (positive - scale[0]) / scale[1]
    place = F.xxhash64("doc_id", *NAMES)
    grouped = feats.select("*", place.alias("place"), F.pmod(place, F.lit(-(-sums["n"] // GROUP_ROWS))).alias("group"))
    w = _averaged(grouped, np.zeros(len(NAMES) + 1), positive, scale, 0.5)
    prior = estimated_prior(feats, positive, w, scale)
    for _ in range(ROUNDS):
        w = _averaged(grouped, w, positive, scale, prior)
    return feats.select("doc_id", (1 / (1 + F.exp(-_margin(w, scale)))).alias("score"))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where(~held_out() & (F.col("quality") == 1))
    out = score(table(spark, sf_dir, "documents"), trusted)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op1_quality": op1_quality}
SQL: dict[str, str] = {}
