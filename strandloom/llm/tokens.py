"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-split pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(vocabulary: str = DEFAULT_VOCABULARY):
    """The tokenizer of a file of base64 tokens and ranks; the file must be at this path on every machine."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sizes(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            at = batch.schema.get_field_index("text")
            counts = pa.array([len(encode(t)) if t else 0 for t in batch.column(at).to_pylist()], pa.int64())
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*columns, counts], names=[*names, "n_tokens"])

    return run


def with_sizes(df: DataFrame, text: str = "text", keep: dict[str, str] | None = None, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The columns ``keep`` (new name -> column or expression) and ``n_tokens`` (0 for a null or empty text) of every row."""
    keep = keep or {"doc_id": "doc_id"}
    rows = df.select(*(F.expr(e).alias(n) for n, e in keep.items()), F.col(text).cast("string").alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_sizes(vocabulary), f"{schema}, n_tokens long")
