"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary of ranks for tiktoken; the file stays where it is installed.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@functools.cache
def encoding(path: str = TOKENIZER):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, path: str = TOKENIZER) -> int:
    enc = encoding(path)
    try:
        return len(enc.encode_to_numpy(text, disallowed_special=()))
    except AttributeError:
        return len(enc.encode_ordinary(text))


def sized(df: DataFrame, id_col: str, text_col: str, *others: str, path: str = TOKENIZER) -> DataFrame:
    """(id, others..., n_tokens) of each row. Null and empty texts have 0 tokens; null ids give no row."""
    own = df.select(F.col(id_col).cast("bigint").alias("doc_id"), *[F.col(c) for c in others], F.coalesce(F.col(text_col), F.lit("")).alias("__text")).where("doc_id is not null")
    kinds = dict(own.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.fromiter((count(t, path) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()), np.int32, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n)], names=["doc_id", *others, "n_tokens"])

    return own.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *others)) + ", n_tokens int")
