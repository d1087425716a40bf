"""Quality rules: word and line statistics, and bands of zstandard ratios.

A text's compressed size over its size is taken for the whole text and for fixed chunks. Short texts compress less, so
each band of lengths has its own limits; below the lower one a text repeats itself, above the upper one it is noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (bytes, lowest ratio) for whole texts and chunks, linear in the logarithm of the size in between; texts of fewer bytes than
#: the first have no limits. They lie just under prose: the labelled good texts of the tables reach down to 0.496, 0.462,
#: 0.448, 0.426, 0.413, 0.402 from 724, 1448, 2896, 5793, 11585, 23170 bytes to the next power of two, while half of the
#: labelled junk that passes the word rules has at most 0.504, 0.451, 0.417, 0.391, 0.371, 0.365 there. Of longer texts few are
#: labelled, so their limits are wider.
LOWEST = ((256, 0.508), (512, 0.506), (1024, 0.482), (2048, 0.453), (4096, 0.436), (8192, 0.416), (16384, 0.400), (32768, 0.360), (65536, 0.340))
#: (bytes from, highest ratio); the last row whose size is reached holds. The limits lie between prose of the tables (at most
#: 0.82, 0.72, 0.60, 0.53, 0.48 from 256, 512, 1024, 2048, 4096 bytes) and random words of letters and digits (0.91, 0.81,
#: 0.76, 0.74, 0.73). Random hex digits (0.52) stay inside.
HIGHEST = ((0, 9.0), (256, 0.88), (512, 0.78), (1024, 0.70), (4096, 0.68), (16384, 0.66))
CHUNK_BYTES = 4096
#: The lowest ratio of a chunk, in parts of that of a text of its size: a part varies more than a whole.
CHUNK_LOW = 0.94
#: Share of the judged chunks (those of a size that has limits) that may lie outside their band.
CHUNK_SHARE = 0.2
LEVEL = 3
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "whole_ratio": "double", "n_chunks": "long", "low_chunks": "long", "high_chunks": "long", "kept": "boolean"}


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words that occurs twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids, _ = pd.factorize(np.array(words, dtype=object))
    size = int(ids.max()) + 1
    pair, _ = pd.factorize(ids[:-1] * size + ids[1:])
    code, uniq = pd.factorize(pair[:-1].astype(np.int64) * size + ids[2:])
    often = np.bincount(code, minlength=len(uniq))[code] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= often
    return int(inside.sum())


def band(size: int) -> tuple[float, float]:
    """Lowest and highest ratio that a whole text or chunk of this size may have."""
    if size < LOWEST[0][0]:
        return 0.0, HIGHEST[0][1]
    low = np.interp(np.log2(size), [np.log2(n) for n, _ in LOWEST], [ratio for _, ratio in LOWEST])
    return float(low), next(ratio for least, ratio in reversed(HIGHEST) if size >= least)


def ratios(data: bytes, squeeze: zstandard.ZstdCompressor) -> tuple[float, int, int, int]:
    """Ratio of the whole text (1 if empty), chunks judged, chunks below and above their band."""
    whole = len(squeeze.compress(data)) / len(data) if data else 1.0
    n = low = high = 0
    if len(data) > CHUNK_BYTES:
        for at in range(0, len(data), CHUNK_BYTES):
            part = data[at : at + CHUNK_BYTES]
            least, most = band(len(part))
            ratio = len(squeeze.compress(part)) / len(part)
            n, low, high = n + (len(part) >= LOWEST[0][0]), low + (ratio < CHUNK_LOW * least), high + (ratio > most)
    return whole, n, low, high


def judge(text: str | None, squeeze: zstandard.ZstdCompressor) -> tuple:
    data = (text or "").encode(errors="replace")
    words = data.split()
    # bytes.split() parts at the six ASCII white space characters, as the word pattern asks
    word_chars = len(text or "") - sum(data.count(c) for c in SPACE)
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
    repeats = repeated_words(words)
    base = len(words) < 50 or 100 * repeats > 50 * len(words)
    whole, n, low, high = ratios(data, squeeze)
    least, most = band(len(data))
    kept = not base and least <= whole <= most and low + high <= CHUNK_SHARE * n
    return len(words), word_chars, n_symbols, len(lines) - len(set(lines)), repeats, base, whole, n, low, high, kept


def rule_column(text: Column) -> Column:
    """Struct of COLUMNS for a text."""
    kinds = {"long": "int64", "double": "float64", "boolean": "bool"}

    @F.pandas_udf("struct<" + ", ".join(f"{k}: {v}" for k, v in COLUMNS.items()) + ">")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        for texts in parts:
            yield pd.DataFrame([judge(t, squeeze) for t in texts], columns=list(COLUMNS)).astype({k: kinds[v] for k, v in COLUMNS.items()})

    return run(text)


def apply_rules(docs: DataFrame) -> DataFrame:
    """doc_id and COLUMNS of every document.

    A null text counts as empty: no words, base_failed, not kept. Repeated rows get equal values, null ids give a row
    each; an empty table gives an empty result; other columns are ignored. Nothing is shuffled.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), rule_column(F.col("text")).alias("r")).select("doc_id", "r.*")


def keep_clean(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that pass the rules."""
    return docs.filter(rule_column(F.col("text"))["kept"])
