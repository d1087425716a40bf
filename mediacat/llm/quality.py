"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

The raw model counts every document; the target model counts documents labelled good (a sample of at most
`most_target`, chosen by a hash of the id). A document's log weight is the log ratio of the two models over the n-grams of
its lowest window, all windows being of one size, so neither length nor a good rest makes up for a junk passage. Its
key is the log weight plus Gumbel noise, at scale 1, that a hash of its text and the seed settles. The k documents of
the largest keys stay, which draws k of them without replacement in proportion to their importance weights.

k is a share of all documents: `share` if given, else the share of good ones among the labelled, plus two standard errors
of it or `slack`, whichever is more, so that an error of the estimate costs junk kept rather than good text lost.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm.common import Scratch, map_batches, record, text_groups
from mediacat.llm.words import CharClasses, joined, mix, names

BITS = 16
#: N-grams in a window; the next window begins half of it later.
WINDOW = 100
WORD, SIGN, LINE, SPACE, END = range(5)


class WordClasses(CharClasses):
    """Letters and digits go in runs, underscores too, and so do other visible characters."""

    def ask(self, c: str) -> int:
        return SPACE if c.isspace() else LINE if c == "_" else WORD if c.isalnum() else SIGN


@functools.cache
def classes() -> WordClasses:
    return WordClasses(END)


def buckets(texts: list[str | None]) -> list[np.ndarray]:
    """Hashed n-grams of each text in order: every word, then its pair with the next one. Repeats are kept."""
    out: list[np.ndarray] = []
    for a, b in text_groups(texts):
        data, ends = joined([(t or "").encode(errors="replace") for t in texts[a:b]])
        kind = classes().of(data[: ends[-1] + 1], ends)
        start = np.append(True, kind[1:] != kind[:-1])
        begin = np.flatnonzero(start)
        size = np.append(begin[1:], len(kind)) - begin
        keep = kind[begin] < SPACE
        begin, size = begin[keep], size[keep]
        first = np.searchsorted(begin, np.append(0, ends + 1))
        word = names(data, begin, size)
        line = np.empty(max(0, 2 * len(word)), np.int64)
        line[0::2] = word >> np.uint64(64 - BITS)
        line[1:-1:2] = mix(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:]) >> np.uint64(64 - BITS)
        out += [line[2 * lo : max(2 * lo, 2 * hi - 1)] for lo, hi in zip(first, first[1:], strict=False)]
    return out


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the one text column of a table; 2**BITS numbers reach the driver at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            total += np.bincount(np.concatenate(buckets(batch.column(0).to_pylist())), minlength=1 << BITS)
        at = np.flatnonzero(total)
        yield record({"bucket": at, "n": total[at]}, pa.schema([("bucket", pa.int64()), ("n", pa.int64())]))

    rows = map_batches(texts, run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BITS)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, share: float = 2.0, least: float = 16.0) -> np.ndarray:
    """Log of the target model over the raw model. Both get further occurrences, the same for each bucket: `share` times the
    target's mass in all, and `least` a bucket, since chance in the counts of a small target does not shrink with it.
    Rare n-grams, which a sample of good texts may simply lack, then say little."""
    if not target.sum() or not raw.sum():
        return np.zeros(len(raw))
    prior = share * target.sum() / len(target) + least
    expected = raw / raw.sum() * target.sum()
    return np.log((target + prior) / (expected + prior))


def known_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))


def target_texts(docs: DataFrame, labels: DataFrame, most_target: int) -> DataFrame:
    good = known_labels(labels).filter("quality = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_target)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(good), "doc_id").select("text")  # broadcast: most_target numbers


def fit(docs: DataFrame, labels: DataFrame, most_target: int = 20_000) -> np.ndarray:
    return log_ratio(bucket_counts(target_texts(docs, labels, most_target)), bucket_counts(docs.select("text")))


def lowest_window(x: np.ndarray) -> float:
    """The least sum over a window of the log ratios of a text; a text of fewer n-grams is one window."""
    if len(x) <= WINDOW:
        return float(x.sum())
    upto = np.concatenate([[0.0], np.cumsum(x)])
    start = np.append(np.arange(0, len(x) - WINDOW, WINDOW // 2), len(x) - WINDOW)
    return float((upto[start + WINDOW] - upto[start]).min())


def weight_column(spark: SparkSession, ratio: np.ndarray, text: Column, seed: int) -> Column:
    """Struct of a text's log_weight (of its lowest window), n_grams, and sample_key: log_weight plus Gumbel noise."""
    shared = spark.sparkContext.broadcast(ratio)  # 2**BITS numbers whatever the input

    @F.pandas_udf("struct<log_weight: double, n_grams: long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        part = texts.tolist()
        rows = [(lowest_window(shared.value[x]), len(x)) for a, b in text_groups(part) for x in buckets(part[a:b])]
        return pd.DataFrame(rows, columns=["log_weight", "n_grams"]).astype({"log_weight": "float64", "n_grams": "int64"})

    noise = (F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit("")), F.lit(seed)), 12) + F.lit(0.5)) / F.lit(float(2**52))
    got = run(text)
    return F.struct(got["log_weight"].alias("log_weight"), got["n_grams"].alias("n_grams"), (got["log_weight"] - F.log(-F.log(noise))).alias("sample_key"))


def top_k_threshold(keys: DataFrame, column: str, k: int, bins: int = 1024, rounds: int = 8) -> float | None:
    """The k-th largest value of a double column, by histograms that narrow down; None keeps all, inf none.

    The driver sees `bins` counts a round. Ends early when a bin holds one value only.
    """
    n, low, high = keys.agg(F.count(column), F.min(column), F.max(column)).first()
    if k >= n:
        return None
    if k <= 0:
        return float("inf")
    for _ in range(rounds):
        if low == high:
            break
        width = (high - low) / bins
        cell = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        got = keys.filter(F.col(column).between(low, high)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(got, key=lambda r: -r["cell"]):
            if k <= r["n"]:
                low, high = r["lo"], r["hi"]
                break
            k -= r["n"]
        else:
            break
        if width == 0:
            break
    return low


def kept_share(labels: DataFrame, slack: float) -> float:
    """The share of documents to keep, from the labels; 1 without any."""
    n, good = known_labels(labels).agg(F.count("*"), F.sum("quality")).first()
    if not n:
        return 1.0
    share = (good or 0) / n
    return min(1.0, share + max(slack, 2 * math.sqrt(share * (1 - share) / n)))


def weighed(docs: DataFrame, labels: DataFrame, s: Scratch, columns: list[str], most_target: int = 20_000, share: float | None = None, slack: float = 0.01, seed: int = 0) -> tuple[Column, DataFrame, float | None]:
    """The weight struct of each text, a written table of the named columns and `w`, that struct, and the least sample_key
    that stays (None: all stay).

    Equal texts have equal keys and share their fate, so a tie at the edge stays whole. Null and empty texts weigh 0.
    With no labelled good text all ratios are 0. Every document stays if none is labelled.
    """
    weight = weight_column(docs.sparkSession, fit(docs, labels, most_target), F.col("text"), seed)
    rows = (s.keep if columns else s.cut)(docs.select(*columns, weight.alias("w")), "quality-weights")
    wanted = kept_share(labels, slack) if share is None else share
    return weight, rows, top_k_threshold(rows.select(F.col("w.sample_key").alias("key")), "key", math.ceil(wanted * rows.count()))


def score(docs: DataFrame, labels: DataFrame, **settings: float) -> DataFrame:
    """doc_id, log_weight, n_grams, sample_key, kept of every document.

    Repeated rows and null ids give a row each; an empty table gives an empty result; other columns are ignored.
    """
    with Scratch(docs.sparkSession) as s:
        _, rows, edge = weighed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, s, ["doc_id"], **settings)
    kept = F.lit(True) if edge is None else F.col("w.sample_key") >= F.lit(edge)
    return rows.select("doc_id", "w.log_weight", "w.n_grams", "w.sample_key", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **settings: float) -> DataFrame:
    """The rows of docs, with all their columns, that importance resampling keeps. Only weights are written: a text is
    weighed once to find the edge and once more where the result is read, which costs less than another copy of all texts."""
    with Scratch(docs.sparkSession) as s:
        weight, _, edge = weighed(docs, labels, s, [], **settings)
    return docs if edge is None else docs.filter(weight["sample_key"] >= F.lit(edge))
