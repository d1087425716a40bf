"""Toxicity: logistic regression over character n-grams scaled by naive Bayes log-count ratios.

A text scores as its highest window: windows of 2 * STEP characters, each a half over the next, cover every whole text, so
a clean rest does not outvote a passage. Fitting uses a bounded sample of labelled rows (`most_positive`,
`most_negative`, chosen by a hash of the id). The log-count ratios of whole texts pick the first window of each; then
ratios and weights are fitted on windows, `rounds` times, each time on those that the last model puts highest. Features
are never gathered: their counts and the gradients are sums over the sample's partitions. Ids, sources, languages and
labels are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from mediacat.llm.common import Scratch, map_batches, record

ORDERS = (4, 5, 6)
BITS = 20
#: Characters from the start of a window to the start of the next; a window holds the n-grams that begin in two such steps.
STEP = 256
SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


@dataclass
class Model:
    """Weight of each hashed n-gram (already times its log-count ratio), and the intercept."""

    weights: np.ndarray
    bias: float


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def grams(text: str | None) -> np.ndarray:
    """Hashed n-grams of characters of the lower-cased text between blanks at each position, all orders; repeats are kept."""
    data = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", errors="replace"), np.uint32)
    out = []
    for n in ORDERS:
        if len(data) >= n:
            h = np.full(len(data) - n + 1, n, np.uint32)
            for k in range(n):
                h = (h ^ data[k : len(data) - n + 1 + k]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            out.append(h >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def starts(n_grams: int) -> np.ndarray:
    """Character at which each of the n-grams that `grams` gives begins."""
    size = (n_grams + sum(ORDERS) - len(ORDERS)) // len(ORDERS)
    if size < max(ORDERS):  # shorter texts lack some orders
        size = next((x for x in range(max(ORDERS)) if sum(max(0, x - n + 1) for n in ORDERS) == n_grams), 0)
    return np.concatenate([np.arange(max(0, size - n + 1), dtype=np.int32) for n in ORDERS])


def highest_window(at: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """The largest sum of weights of the distinct n-grams of a window, and those n-grams, weightless ones too."""
    high, best, step = window_sums(at, weights)
    return high, np.unique(at[(step >= best) & (step <= best + 1)])


def window_sums(at: np.ndarray, weights: np.ndarray) -> tuple[float, int, np.ndarray]:
    """The largest sum of weights, its window, and the step in which each n-gram begins."""
    step = starts(len(at)) // STEP
    n = max(1, int(step.max(initial=0)))
    known = np.flatnonzero(weights[at])
    pairs = step[known].astype(np.int64)
    first, second = np.minimum(pairs, n - 1), np.flatnonzero((pairs >= 1) & (pairs < n))
    key = np.sort(np.concatenate([first << BITS | at[known], (pairs[second] - 1) << BITS | at[known[second]]]))
    key = key[np.diff(key, prepend=-1) != 0]
    sums = np.bincount(key >> BITS, weights=weights[key & ((1 << BITS) - 1)].astype(np.float64), minlength=n)
    best = int(sums.argmax())
    return float(sums[best]), best, step


def labelled_sample(docs: DataFrame, labels: DataFrame, most_positive: int, most_negative: int) -> DataFrame:
    """(label, text) of at most so many rows of each class; which ones is settled by a hash of the id."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = rows.filter("label = 1").orderBy(*order).limit(most_positive).unionByName(rows.filter("label = 0").orderBy(*order).limit(most_negative))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.join(F.broadcast(picked), "doc_id").select("label", "text")  # broadcast: most_positive + most_negative pairs of numbers
    return found.repartition(docs.sparkSession.sparkContext.defaultParallelism)


def gram_counts(sample: DataFrame, model: Model | None, least_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """N-grams of at least `least_docs` texts (highest windows by the model), the texts of label 0 and 1 that have each,
    and all texts of either. At most 2**BITS rows reach the driver."""
    schema = pa.schema([("gram", pa.int32()), ("neg", pa.int64()), ("pos", pa.int64())])
    chosen = chooser(sample, model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int32)
        total = [0, 0]
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[label, chosen(text)] += 1
                total[label] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield record({"gram": np.append(at, -1), "neg": np.append(seen[0, at], total[0]), "pos": np.append(seen[1, at], total[1])}, schema)

    table = map_batches(sample, count, "gram int, neg long, pos long").groupBy("gram").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    sums = table.filter((F.col("gram") == -1) | (F.col("neg") + F.col("pos") >= least_docs)).toArrow()
    gram, neg, pos = (sums.column(c).to_numpy() for c in ("gram", "neg", "pos"))
    rows, whole = np.flatnonzero(gram >= 0), gram == -1
    rows = rows[np.argsort(gram[rows])]
    return gram[rows], neg[rows], pos[rows], int(neg[whole].sum()), int(pos[whole].sum())


def chooser(sample: DataFrame, model: Model | None):
    """Function from a text to its distinct n-grams, those of its highest window if there is a model."""
    if model is None:
        return lambda text: np.unique(grams(text))
    shared = sample.sparkSession.sparkContext.broadcast(model.weights)  # 4 MiB whatever the input
    return lambda text: highest_window(grams(text), shared.value)[1]


def log_count_ratio(neg: np.ndarray, pos: np.ndarray, n_neg: int, n_pos: int) -> np.ndarray:
    return np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = 6000, most_negative: int = 12000, least_docs: int = 4, least_ratio: float = 1.0, ridge: float = 1e-3, steps: int = 60, rounds: int = 2) -> Model:
    """The model of the sample. N-grams count from `least_docs` texts and a log-count ratio of `least_ratio` either way.

    Without rows of both classes every score is the smoothed share of label 1.
    """
    with Scratch(docs.sparkSession) as s:
        sample = s.cut(labelled_sample(docs, labels, most_positive, most_negative), "toxicity-sample")  # each round reads it twice
        model = None
        for _ in range(rounds + 1):
            gram, neg, pos, n_neg, n_pos = gram_counts(sample, model, least_docs)
            ratio = log_count_ratio(neg, pos, n_neg, n_pos)
            strong = np.abs(ratio) >= least_ratio
            gram, ratio = gram[strong], ratio[strong]
            weights = np.zeros(1 << BITS, np.float32)
            if not n_neg or not n_pos or not len(gram):
                return Model(weights, float(np.log((n_pos + 0.5) / (n_neg + 1.5))))
            scale, bias = (1.0, 0.0) if model is None else logistic(sample, model, gram, ratio, n_neg, n_pos, ridge, steps)
            weights[gram] = (ratio * scale).astype(np.float32)
            model = Model(weights, bias)
    return model


def logistic(sample: DataFrame, model: Model, gram: np.ndarray, ratio: np.ndarray, n_neg: int, n_pos: int, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights of the n-grams, each scaled by its ratio, and the intercept of a ridge logistic regression in which both
    classes weigh the same."""
    place = np.full(1 << BITS, -1, np.int32)
    place[gram] = np.arange(len(gram))
    shared = sample.sparkSession.sparkContext.broadcast((place, ratio))  # 12 MiB at most
    chosen, size = chooser(sample, model), len(gram)
    vector = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
    schema = pa.schema([("label", pa.float64()), ("share", pa.float64()), ("features", vector)])
    own = (0.5 / n_neg, 0.5 / n_pos)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, ratios = shared.value
        for batch in batches:
            label = batch.column(0).to_pylist()
            hits = [places[chosen(text)] for text in batch.column(1).to_pylist()]
            hits = [np.sort(at[at >= 0]) for at in hits]
            yield record({"label": label, "share": [own[y] for y in label], "features": [{"type": 0, "size": size, "indices": at, "values": ratios[at]} for at in hits]}, schema)

    ddl = StructType().add("label", DoubleType()).add("share", DoubleType()).add("features", VectorUDT())
    rows = map_batches(sample, present, ddl).persist()
    try:
        found = LogisticRegression(maxIter=steps, regParam=ridge, standardization=False, weightCol="share", family="binomial").fit(rows)
    finally:
        rows.unpersist()
    return found.coefficients.toArray(), float(found.intercept)


def score_text(text: str | None, weights: np.ndarray, bias: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(window_sums(grams(text), weights)[0] + bias, -30, 30))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from a score of 0.5) of every document.

    Null and empty texts get the score of no n-gram; repeated rows give a row each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # 4 MiB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            scores = np.array([score_text(t, weights, bias) for t in batch.column(2).to_pylist()])
            yield record({"doc_id": batch.column(0), "held_out": batch.column(1), "score": scores, "predicted": (scores >= 0.5).astype(np.int32)}, SCHEMA)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")
