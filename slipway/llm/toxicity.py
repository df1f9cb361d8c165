"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every coordinate has its own learning rate, and the L1 term leaves most weights at exactly zero, so the fitted model
is a short list of (index, weight) rows that is broadcast to the scoring tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from slipway.llm import text as T
from slipway.llm.common import small_batches

DIMS = 1 << 18  # bounds the model: at most DIMS weights of 12 bytes, 3 MB
SAMPLE_ROWS = 12000  # labelled rows the model is fitted on, about; a fixed bound, whatever the corpus holds
ALPHA, BETA = 0.3, 1.0
SELECT_L1, SELECT_EPOCHS = 1.2, 5  # the first run's L1, times the root of the number of toxic rows
FINAL_L1, FINAL_EPOCHS = 1.0, 10
BIAS = DIMS


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed index of every word, word pair and pair with one word skipped, and its text's index."""
    h, first = T.words(texts, T.ALNUM)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out, of = [h], [owner]
    for gap, salt in ((1, 0x51), (2, 0x52)):
        a, b = h[:-gap], h[gap:]
        same = owner[:-gap] == owner[gap:]
        out.append(T.mix(a[same] * np.uint64(3) + b[same] + np.uint64(salt)))
        of.append(owner[:-gap][same])
    return (np.concatenate(out) % np.uint64(DIMS)).astype(np.int64), np.concatenate(of)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in T.slices(batch, "text"):
            index, owner = features(part.column("text"))
            key = np.unique(owner * DIMS + index)
            cuts = np.searchsorted(key, np.arange(part.num_rows + 1) * DIMS)
            index = (key % DIMS).astype(np.uint32)
            packed = [index[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.record_batch([part.column("id"), part.column("toxic"), pa.array(packed, pa.binary())],
                                  names=["id", "toxic", "packed"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two runs: one with a strong L1 term selects coordinates, one with a weak term fits the selected."""
    rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
    rows.sort(key=lambda r: (r[0], r[1]))
    examples = [(np.append(np.frombuffer(p, np.uint32).astype(np.int64), BIAS), y) for _, y, p in rows]
    strong = SELECT_L1 * max(1.0, float(sum(y for _, y in examples))) ** 0.5
    live = _ftrl(examples, strong, SELECT_EPOCHS) != 0
    live[BIAS] = True
    w = _ftrl([(i[live[i]], y) for i, y in examples], FINAL_L1, FINAL_EPOCHS)
    keep = np.flatnonzero(w)
    yield pa.record_batch([pa.array(keep, pa.int64()), pa.array(w[keep], pa.float64())], names=["i", "w"])


def _ftrl(examples: list[tuple[np.ndarray, int]], strength: float, epochs: int) -> np.ndarray:
    z, n, l1 = np.zeros(DIMS + 1), np.zeros(DIMS + 1), np.full(DIMS + 1, strength)
    l1[BIAS] = 0.0
    order = np.random.default_rng(0)
    for _ in range(epochs if examples else 0):
        for k in order.permutation(len(examples)):
            i, y = examples[k]
            zi, ni = z[i], n[i]
            w = _weights(zi, ni, l1[i])
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[i] = ni + g * g
    return _weights(z, n, l1)


def _weights(z: np.ndarray, n: np.ndarray, l1: np.ndarray) -> np.ndarray:
    shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0.0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA)


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Weights (i, w) of a model fitted on about ``sample_rows`` labelled rows for which ``learn_from`` holds.

    The rows are drawn by a hash of their id, over all labels. Labels other than 0 and 1, and null ids, are not used;
    of conflicting labels of one id the larger counts. Without any usable row the result is empty.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter(
        F.col("toxic").isin(0, 1) & F.col("id").isNotNull())
    known = known.withColumnRenamed("id", id_col).filter(learn_from).withColumnRenamed(id_col, "id")
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    share = int(min(1.0, sample_rows / max(1, total)) * (1 << 30))
    drawn = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(drawn), "id").select("id", "toxic", "text")  # at most about sample_rows short rows
    packed = rows.mapInArrow(_packed, "id long, toxic int, packed binary")
    return packed.repartition(1).mapInArrow(_fit, "i long, w double")  # one task for a sample of fixed size


def scorer(weights: DataFrame):
    """A column function text -> probability. ``weights`` holds at most DIMS + 1 rows."""
    rows = weights.collect()
    trained = bool(rows)
    index, value = np.array([r.i for r in rows], np.int64), np.array([r.w for r in rows], np.float64)
    sent = weights.sparkSession.sparkContext.broadcast((index, value))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if not trained:
            return pa.array(np.zeros(len(texts)))
        w = np.zeros(DIMS + 1)
        w[sent.value[0]] = sent.value[1]
        out = []
        for part in T.slices(pa.record_batch([texts], names=["text"]), "text"):
            i, owner = features(part.column("text"))
            live = np.flatnonzero(w[i])
            key = np.unique(owner[live] * DIMS + i[live])
            total = np.bincount(key // DIMS, w[key % DIMS], part.num_rows) + w[BIAS]
            out.append(1.0 / (1.0 + np.exp(-np.clip(total, -30, 30))))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return score


def learned(id_col: str = "doc_id") -> Column:
    """The fold that labels may be taken from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.col(id_col).cast("string")) % 5 != 0


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) appended; only the text is an input of a score.

    Null and empty texts get the score of a text without features. Repeated rows get equal scores. If no label can be
    learned from, every score is 0. A column of that name is replaced; other columns pass through.
    """
    score = scorer(fit(docs, labels, learned(id_col), id_col, text_col))
    return docs.withColumn("toxicity", score(F.coalesce(F.col(text_col), F.lit(""))))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents scored 0.5 or more; the columns stay as they are.

    Each row is judged by its own text: rows sharing an id are independent, repeated rows stay or go together, null and
    empty texts get the score of a text without features. An empty table gives no rows; without labels all rows stay.
    """
    score = scorer(fit(docs, labels, learned(id_col), id_col, text_col))
    return docs.filter(score(F.coalesce(F.col(text_col), F.lit(""))) < 0.5)
