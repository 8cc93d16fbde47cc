"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: how this vocabulary cuts text before its merges apply
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict[str, object] = {}
_SENT: set[str] = set()


def encoding(path: str = TOKENIZER):
    """The tokenizer of a file of ranks, loaded once in each Python worker. Where the path isn't on a worker's machine, the copy that was sent is read."""
    if path not in _LOADED:
        import tiktoken
        from pyspark import SparkFiles

        with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _LOADED[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_counts(df: DataFrame, id_col: str, text_col: str, keep: list[str] = (), path: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens, kept columns): the size of every text, over the whole text. Null and empty texts have no tokens."""
    context = df.sparkSession.sparkContext
    if not context.master.startswith("local") and path not in _SENT:  # workers on other machines get the file once
        context.addFile(path)
        _SENT.add(path)
    fields = [f"{c} {df.schema[c].dataType.simpleString()}" for c in keep]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *batch.columns[2:]], ["id", "n_tokens", *keep])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keep)
    return rows.mapInArrow(count, ", ".join([f"id {df.schema[id_col].dataType.simpleString()}", "n_tokens long", *fields]))
