"""Token counts with a whole-token shortcut.

Before the scan, every string of the vocabulary is encoded alone by the library; those that give exactly their own
token are proven. A pre-token that equals a proven string counts one token without any merge; only the rest are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.llm.common import map_batches, record
from mediacat.llm.pieces import Encoder, encoder

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def proven_words(enc: Encoder) -> list[bytes]:
    """The vocabulary strings that are one pre-token and that the library encodes, alone, as just their own token."""
    byte_of = {c: b for b, c in enumerate(enc.alphabet)}
    words: list[str] = []
    ids: list[int] = []
    for token, i in enc.vocab.items():
        if token.endswith(enc.suffix) and all(c in byte_of for c in token[: len(token) - len(enc.suffix)]):
            try:
                words.append(bytes(byte_of[c] for c in token[: len(token) - len(enc.suffix)]).decode())
            except UnicodeDecodeError:
                continue
            ids.append(i)
    alone = enc.library.encode_batch(words, add_special_tokens=False)
    return enc.single([w for w, i, got in zip(words, ids, alone, strict=True) if got.ids == [i]])


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens as the library counts them, over_limit (n_tokens > limit).

    Null and empty texts count 0; repeated rows and null ids give a row each; other columns are ignored; an empty
    table gives an empty result. The broadcast is bounded by the vocabulary.
    """
    proven = docs.sparkSession.sparkContext.broadcast(proven_words(Encoder(path)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        if not len(enc.proven):
            enc.trust(proven.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = enc.count(texts)
            yield record({"doc_id": batch.column(0), "n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": n, "over_limit": n > limit}, SCHEMA)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
